"""The engine's entities over the driver's tables, each with its SQL twin (a common table expression)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import md5_int, md5_sql
from ..sources.io import table

_MODEL = "CASE doc_id % 3 WHEN 0 THEN 'org/alpha-7b' WHEN 1 THEN 'org/beta-7b' ELSE 'org/gamma-13b' END"
_QUANT = "CASE {div} % 4 WHEN 0 THEN NULL WHEN 1 THEN 'float8' WHEN 2 THEN 'int8' ELSE 'int4' END"
_SIZE = "CASE {div9} % 3 WHEN 0 THEN 350 WHEN 1 THEN 550 ELSE 750 END"
_COUNT = "CASE {div3} % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END"
_TEMPLATE = "CASE doc_id % 3 WHEN 0 THEN 'context_first' WHEN 1 THEN 'question_first' ELSE 'reminder' END"


def _columns(divide: str) -> dict[str, str]:
    d = lambda n: f"(doc_id {divide} {n})"
    size = _COUNT.format(div3=d(3))
    return {
        "id": "doc_id",
        "source": "source",
        "lang": "lang",
        "text": "text",
        "n_chars": "n_chars",
        "model": _MODEL,
        "quantization": _QUANT.format(div=d(3)),
        "chunk_size": _SIZE.format(div9=d(9)),
        "chunks_per_prompt": size,
        "template": _TEMPLATE,
        "answerable": "doc_id % 2 = 1",
        "answer_chunk_index": f"CASE WHEN doc_id % 2 = 1 THEN {d(2)} % ({size}) END",
        "split": "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END",
        "target": "CASE WHEN quality = 1 THEN toxic END",
    }


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled responses: documents with labels; poor quality stands for an invalid label."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.selectExpr(*[f"{e} AS {n}" for n, e in _columns("div").items()])


LABELLED = "lab AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _columns("//").items()) + " FROM documents JOIN labels USING (doc_id))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in [0, 1) with a binary target: id, split, grp, y, score."""
    d = table(spark, sf_dir, "labels").filter("toxic is not null")
    score = (md5_int("doc_id", F.lit("score")) % 1000 + 250 * F.col("toxic")) / F.lit(1250.0)
    return d.select(F.col("doc_id").alias("id"), F.expr(_columns("div")["split"]).alias("split"), F.expr(_MODEL).alias("grp"), F.col("toxic").alias("y"), score.alias("score"))


SCORED = f"scored AS (SELECT doc_id AS id, {_columns('//')['split']} AS split, {_MODEL} AS grp, toxic AS y, ({md5_sql('doc_id', chr(39) + 'score' + chr(39))} % 1000 + 250 * toxic) / 1250.0::DOUBLE AS score FROM labels WHERE toxic IS NOT NULL)"

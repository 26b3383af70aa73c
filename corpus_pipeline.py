"""A corpus from raw documents: quality, exact copies, near copies, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, and other columns of docs,
whatever their names, play no part.

Cases: null and empty texts are rated like any other, equal to each other, no near copies of anything, of size 0 in the mix, and one
piece of one token; very long texts are read whole in every stage; of rows that tie, the stages keep the smallest doc_id, a row without one
only where none has one; rows that repeat with their doc_id are one document from the exact stage on; rows the mix draws twice are packed twice; an empty table gives an empty
one in every stage; without labels of two grades nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import exact_dedup, mixing, near_dedup, packing, quality
from gristmill.llm.common import scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose probability of a sound grade is below one half. Toxic documents of sound quality stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.rate(docs, model).filter("kept").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays."""
    return exact_dedup.keep_first(docs, COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the smallest doc_id stays."""
    return near_dedup.keep_one(docs, COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.draw(docs, COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.pack_documents(docs, 2048)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The fitted classifier, weighted sampling and tokens are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

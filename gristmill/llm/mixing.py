"""Operator 5: mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source is given a share of all words; a document's expected copies are its source's
target over its source's size. The expected copies are summed up along the source, one offset
in [0, 1) is added, and a document is emitted once for each integer that the running sum
crosses. Within a source the order is by the size's first two digits, then by a hash cell, then
by size, doc_id and the text's MD5, so every stretch of similar sizes is drawn from in the same proportion and reruns agree.

Whole texts are read once, for their sizes, into a slim written table with each row's locator (file and row number); all counting
and drawing works on that. Texts are moved only by ``draw``, which looks the rows drawn up by locator.

No source is gathered in one task: running sums come from two levels, ranks inside
(source, size class, hash cell) and running counts over those cells. There are at most
``90 * digits * cells`` cells a source, however large the data.

The targets are settled in one task, on a row a source.

Cases: null text counts as empty (size 0, taken 0); very long texts are counted whole; null source is a source of its own, the
last; sources without words get target 0; an empty table gives an empty result; rows that
repeat are drawn each on its own, and which of equal ones does not matter; other columns play no part in ``mix``, ``draw`` returns those asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import AT, bucket_sql, cut, hash_bucket, located

#: What stands between the words of the size: blanks.
BETWEEN = r"[\x20\x09-\x0D]+"
_KEYS = ["_null", "_source", "_class", "_cell"]


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(_null, _source, source_size) to the same with ``target``: shares by weight, filled up to cap times the size.

    Sources stop at their cap in the order of cap over weight, so running sums in that order
    give the level at which the rest share what is left. One row a source.
    """
    by_name = Window.orderBy("_null", "_source")
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    d = sizes.withColumn("_w", turn).withColumn("_top", F.col("source_size") * F.lit(cap))
    rank = Window.orderBy(F.col("_top") / F.col("_w"), "_null", "_source")
    everything, before = Window.partitionBy(), rank.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("_top").over(before), F.lit(0.0))
    d = d.withColumn("_level", left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    d = d.withColumn("_level", F.max(F.when(F.col("_top") / F.col("_w") > F.col("_level"), F.col("_level"))).over(everything))
    return d.select("_null", "_source", "source_size", F.least(F.col("_top"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w")).alias("target"))


def sized(own: DataFrame) -> DataFrame:
    """Written slim table of rows with locators: locator, doc_id, source, size, MD5 of the text."""
    return cut(own.select(*AT, "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_tie")), "mix-sizes")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs``: its locator, doc_id, source, size, source_size, target, copies (times it is drawn) and taken (size * copies)."""
    return settle(sized(located(docs.select("doc_id", "source", "text"))), **options)


def settle(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix-1", cells: int = 256) -> DataFrame:
    d = sizes.withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    digits = F.col("size").cast("string")
    d = d.withColumns({"_class": F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int"), "_cell": hash_bucket(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), cells)})
    counted = d.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size"))
    share = targets(counted.groupBy("_null", "_source").agg(F.sum("_size").alias("source_size")), weights, cap)
    before = Window.partitionBy("_null", "_source").orderBy("_class", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    places = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*_KEYS, "_before").join(share, ["_null", "_source"])
    offset = hash_bucket(F.concat(F.col("_source"), F.col("_null").cast("string"), F.lit(seed)), 65536) / F.lit(65536.0)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("size", "doc_id", "_tie"))
    d = d.join(places, _KEYS).withColumn("_rank", rank + F.col("_before")).withColumns({"_rate": rate, "_offset": offset})
    d = d.withColumn("copies", (F.floor(F.col("_offset") + F.col("_rate") * F.col("_rank")) - F.floor(F.col("_offset") + F.col("_rate") * (F.col("_rank") - 1))).cast("long"))
    return d.select(*AT, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def draw(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """The mix itself: these columns of each row as often as it is drawn."""
    own = located(docs.select(*dict.fromkeys([*columns, "doc_id", "source", "text"])))
    copies = cut(settle(sized(own), **options).filter("copies > 0").select(*AT, F.col("copies").cast("int").alias("_copies")), "mix-copies")
    copies = copies.hint("merge")  # a row a document: at no size broadcast
    return own.join(copies, AT).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*columns)


def mix_sql(docs: str = "documents", columns: str = "", *, seed: str = "mix-1", cells: int = 256) -> str:
    """DuckDB's form of ``mix``, over a table or a subquery."""
    return rf"""
WITH d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, source IS NULL AS sn, coalesce(source, '') AS sv FROM {docs} AS src),
e AS (SELECT *, len(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS cl, {bucket_sql("coalesce(doc_id::VARCHAR, '')", cells)} AS ce FROM d),
s AS (SELECT sn, sv, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, ((row_number() OVER (ORDER BY sn, sv) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS top FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(top) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev FROM w
  WINDOW b AS (ORDER BY top / w, sn, sv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sn, sv, source_size, least(top, coalesce(max(CASE WHEN top / w > lev THEN lev END) OVER (), 0) * w) AS target FROM l),
r AS (SELECT e.*, t.source_size, t.target, row_number() OVER (PARTITION BY e.sn, e.sv ORDER BY cl, ce, size, doc_id, md5(coalesce(text, ''))) AS k,
  {bucket_sql(f"e.sv || e.sn::VARCHAR || '{seed}'", 65536)} / 65536.0::DOUBLE AS u,
  CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM e JOIN t USING (sn, sv)),
m AS (SELECT *, (floor(u + rate * k) - floor(u + rate * (k - 1)))::BIGINT AS copies FROM r)
SELECT {columns or "doc_id, size, source_size, target, copies, copies * size AS taken"} FROM m"""

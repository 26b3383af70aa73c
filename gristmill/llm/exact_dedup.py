"""Operator 8: exact deduplication by a stateful stream with disk-backed keyed state.

A stream of (digest, doc_id, locator) is folded into one state row per digest, kept in
RocksDB without expiry: the smallest identifier seen, the locator of its content, and how many
rows share the digest. A locator is the file that a row stands in and its number there, the same in every
run over the same files. Folding partially before the shuffle, a digest that a third of all rows share
costs a row per task. Where a digest is hit again, the full normalised bytes are fetched by locator, of the
row kept and of its copies, and compared; rows that differ in spite of equal digests are grouped by their bytes.

With a ``state`` folder, the texts, the state and its checkpoint stay there: a later call with more rows takes up the
stream where it ended, and its rows are held against all that came before. Without one, all is in a new shared folder.

Cases: null text counts as empty; very long texts are read whole; a row without doc_id comes after all that have one, so it stays only where none
has; of rows that repeat one doc_id with equal text, that with the smallest locator is
kept; rows with one doc_id and different texts are apart; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AT, cut, located, scratch

BLANKS = r"[\x20\x09-\x0D]+"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _smallest() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *AT))


def fold(rows: DataFrame) -> DataFrame:
    """One row a digest: the smallest (doc_id, locator), nulls last, and the number of rows. Runs on streams and tables."""
    return rows.groupBy("digest").agg(_smallest().alias("keep"), F.count(F.lit(1)).alias("n"))


def stream_state(folder: str, schema: T.StructType, spark: SparkSession, files_per_batch: int = 64, keys_a_store: int = 200_000) -> DataFrame:
    """Stream the rows in ``folder`` that were not streamed before through the keyed state; the state's last row for each digest.

    Each state partition is a RocksDB instance that sets 4 MB aside for its manifest, so their
    number follows the rows of the first call, one for ``keys_a_store`` and at least one a core.
    """
    stores = max(spark.sparkContext.defaultParallelism, -(-spark.read.schema(schema).parquet(f"{folder}/rows").count() // keys_a_store))
    found = f"{folder}/seen"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/rows")

    def keep(batch: DataFrame, number: int) -> None:  # a batch that runs again writes the same folder
        batch.write.mode("overwrite").parquet(f"{found}/batch={number}")

    settings = _STATE | {"spark.sql.streaming.internal.stateStore.partitions": str(stores)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = fold(stream)
        query = out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    there = spark._jvm.org.apache.hadoop.fs.Path(found)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], out.schema)
    seen = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(found)
    last = F.max_by(F.struct("keep", "n"), F.col("batch"))
    return seen.groupBy("digest").agg(last.alias("s")).select("digest", "s.keep", "s.n")


def dedup(docs: DataFrame, *, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 64, state: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, its locator, keep_id, group_size, kept, digest."""
    spark = docs.sparkSession
    folder = state or scratch(spark, "dedup-state")
    if state:  # the bytes must be there when a later call compares with them
        run = f"{folder}/texts/run={uuid.uuid4().hex}"
        docs.select("doc_id", "text").write.parquet(run)
        own, texts = (located(spark.read.schema("doc_id long, text string").parquet(p)) for p in (run, f"{folder}/texts"))
    else:
        own = texts = located(docs.select("doc_id", "text"))
    return _dedup(own, texts, folder, digest, files_per_batch)


def _dedup(own: DataFrame, texts: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 64) -> DataFrame:
    spark = own.sparkSession
    rows = own.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), *AT)
    path = f"{folder}/rows/run={uuid.uuid4().hex}"
    rows.write.parquet(path)
    mine = spark.read.schema(rows.schema).parquet(path)
    every = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    groups = cut(stream_state(folder, rows.schema, spark, files_per_batch), "dedup-groups")
    hits = content(every, groups, texts)
    kept = F.struct(*AT) == F.struct(*(F.col(f"keep.{c}") for c in AT))
    columns = ["doc_id", *AT, F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest"]
    wrong = cut(differing(hits), "dedup-differing")
    if wrong.isEmpty():
        return mine.join(groups, "digest").select(*columns)
    apart = hits.join(wrong, "digest", "left_semi")
    by_bytes = apart.groupBy("digest", "norm").agg(_smallest().alias("keep"), F.count(F.lit(1)).alias("n"))
    exact = apart.drop("keep", "n").join(by_bytes, ["digest", "norm"]).join(mine.select(*AT), AT, "left_semi")
    plain = mine.join(wrong, "digest", "left_anti").join(groups, "digest")
    return plain.select(*columns).unionByName(exact.select(*columns))


def content(rows: DataFrame, groups: DataFrame, texts: DataFrame, rows_a_part: int = 512) -> DataFrame:
    """doc_id, locator, digest, keep, part, parts and norm (the normalised text, fetched by locator) of all rows of groups of two and more."""
    many = groups.filter("n > 1").select("digest", "keep", F.ceil(F.col("n") / rows_a_part).cast("int").alias("parts"))
    key = F.xxhash64(*AT).alias("key")
    hits = cut(rows.join(many, "digest").withColumns({"part": F.pmod(F.xxhash64(*AT), F.col("parts")).cast("int"), "key": key}), "dedup-hits")
    text = texts.select(key, *AT, "text").join(hits.filter("parts > 0"), ["key", *AT])  # written and filtered, so Catalyst can hold texts against it before they are shuffled
    return cut(text.select("doc_id", *AT, "digest", "keep", "part", "parts", normalised(F.col("text")).alias("norm")), "dedup-texts")


def differing(hits: DataFrame) -> DataFrame:
    """Check full bytes on hits: digests under which a row's bytes differ from those of the row kept.

    The kept text meets its copies in parts, so no group is one task.
    """
    is_kept = F.struct(*AT) == F.struct(*(F.col(f"keep.{c}") for c in AT))
    kept = hits.filter(is_kept).select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return hits.select("digest", "part", "norm").join(kept, ["digest", "part"]).filter("norm <> kept_norm").select("digest").distinct()


def keep_first(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` without the rows that repeat another."""
    own = located(docs.select(*dict.fromkeys([*columns, "doc_id", "text"])))
    gone = cut(_dedup(own, own, scratch(docs.sparkSession, "dedup-state")).filter("not kept").select(*AT), "dedup-gone")
    return own.join(gone, AT, "left_anti").select(*columns)

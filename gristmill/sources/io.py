"""Sources and sinks. Readers take explicit schemas; sinks write whole tables atomically."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; a local one only where that is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="gristmill-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/gristmill-{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Every JSON file of a folder, each one document or an array of them."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One document a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_days(df: DataFrame, path: str, ts: str, day: str = "created_date") -> None:
    """A folder for each day; rows of a day are spread over as many tasks as they fill."""
    df.withColumn(day, F.to_date(ts)).write.partitionBy(day).parquet(path)


def write_runs(df: DataFrame, path: str, keys: tuple[str, ...] = ("split", "model", "quantization")) -> None:
    """Partition columns instead of file names; a missing quantization is a partition of its own."""
    df.write.partitionBy(*keys).parquet(path)


def runs(spark: SparkSession, path: str, schema: StructType, model: str | None = None, quantization: str | None = "All") -> DataFrame:
    """Rows of a model (partition pruning): quantization "All", "None" for unquantized, or one value."""
    d = spark.read.schema(schema).parquet(path)
    if model is not None:
        d = d.filter(F.col("model") == model)
    if quantization != "All":
        d = d.filter(F.col("quantization").eqNullSafe(F.lit(None if quantization == "None" else quantization)))
    return d


def fingerprint(spark: SparkSession, inputs: list[str]) -> str:
    """What tells one state of the input files from another: their paths, sizes and times of change, added up over all files."""
    if not inputs:
        return "fixed"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inputs).select("path", "length", "modificationTime")  # contents are not read
    one = F.xxhash64("path", "length", "modificationTime")
    r = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.bit_xor(one).alias("hash"), F.sum(one.cast("decimal(38,0)")).alias("total")).first()
    return hashlib.sha256(repr(tuple(r)).encode()).hexdigest()[:32]


def materialised(spark: SparkSession, path: str, make, inputs: list[str] | None = None) -> DataFrame:
    """The table at the path, made and written first where it is absent or was made from another state of the ``inputs``.

    It is written aside, and moved to its place once it is whole: its folder's name holds the inputs' fingerprint and Spark's mark of success is in it. What a crashed
    write leaves blocks nothing and goes with ``sweep``. Of several writers the first one's table stays; a table that is read is never changed.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    own = f"{path}/{fingerprint(spark, inputs or [])}"
    if not fs.exists(at(f"{own}/_SUCCESS")):
        aside = f"{path}/_writing-{uuid.uuid4().hex}"
        make().write.parquet(aside)
        if fs.exists(at(own)) and not fs.exists(at(f"{own}/_SUCCESS")):
            fs.delete(at(own), True)  # a store without atomic moves was interrupted
        if fs.exists(at(own)) or not fs.rename(at(aside), at(own)):
            fs.delete(at(aside), True)
    return spark.read.parquet(own)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete what crashed writers have left at a materialised table's path; none may be writing. The number of folders deleted."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    left = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/_writing-*")) or []
    return sum(bool(fs.delete(x.getPath(), True)) for x in left)


def with_responses(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Answers of an external model, kept as a table, joined to the requests; requests without an answer stay with null."""
    return requests.join(responses, keys, "left")


def earliest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(ts).alias("earliest"))


def between(ts: Column, end: str, start: str) -> Column:
    """Listing window: after end, up to start."""
    return (ts > F.lit(end).cast("timestamp_ntz")) & (ts <= F.lit(start).cast("timestamp_ntz"))

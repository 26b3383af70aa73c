"""Incremental ingestion of listings: new documents go to the folder of their day as files arrive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.articles import new_pages
from ..sources.io import between


def ingest_days(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, ts: str, day: str = "created_date", files_per_batch: int = 1000) -> None:
    """Append each new file's rows to ``out``, partitioned by day; a run takes up where the last one stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.withColumn(day, F.to_date(ts)).writeStream.partitionBy(day).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_listing(spark: SparkSession, source: str, out: str, checkpoint: str, *, start: str, end: str, html: str = "html", files_per_batch: int = 1000) -> None:
    """Append the entries (href, title, created) of arriving listing pages to ``out``: those after ``end`` and up to ``start``, each link once.

    Pages overlap, as entries move on while they are fetched, and come in any order. The event-time watermark is as far behind as the window is long, so
    nothing within it is late, and a link is remembered for at least as long. A run takes up where the last one stopped: it reads new files and adds new links only.
    """
    pages = spark.readStream.schema(f"{html} string").option("maxFilesPerTrigger", files_per_batch).parquet(source)
    entries = pages.select(F.explode(new_pages(F.col(html))).alias("e")).select("e.*").filter(between(F.col("created"), end, start))
    seconds = (datetime.fromisoformat(start) - datetime.fromisoformat(end)).total_seconds()
    timed = entries.withColumn("_at", F.col("created").cast("timestamp")).withWatermark("_at", f"{max(int(seconds), 1)} seconds")
    query = timed.dropDuplicatesWithinWatermark(["href"]).drop("_at").writeStream.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

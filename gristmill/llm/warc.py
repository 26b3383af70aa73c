"""Operator 9: content-addressed WARC archive. Payload bytes are stored once by their SHA-256.

``archive`` writes two Parquet tables into a folder: ``payloads`` (digest, payload), each payload once, and ``headers``,
the exact header bytes of every record with the digest that its block is found by. Rows of equal SHA-256 must
also agree in length and SHA-512, or the write fails. ``reconstruct`` joins the two into the bytes of the
original records; ``parse`` reads records from bytes alone and checks each block against its header; ``resolve`` gives
revisits what they refer to. Of records with equal payloads of at least ``least`` bytes, the one with the smallest
page_id is a response and the others are revisits of it, without a block of their own; smaller ones are all responses.

A payload is moved twice: once to be written, folded in each task first, so one that a third of all rows share stays small, and once to
meet the header of its response. Which page keeps it, and what revisits refer to, is settled on slim tables. A small payload that many responses share meets
them in parts of ``rows_a_part``, so no payload is one task.

Cases: null html is an empty payload; null url leaves the target out; line breaks in a url are
percent-encoded; very long pages are one record; rows without page_id come after those with one; rows that repeat the smallest
page_id with its payload are responses too; an empty table gives an empty archive; other columns
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, scratch, writing

DATE = "2026-01-01T00:00:00Z"
_PAYLOADS = T.StructType().add("digest", "string").add("parts", "integer").add("payload", "binary")
_HEADERS = T.StructType().add("page_id", "long").add("digest", "string").add("part", "integer").add("header", "binary")
_END = "\r\n\r\n"


def _record(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def archive(pages: DataFrame, path: str, *, least: int = 100, date: str = DATE, rows_a_part: int = 512) -> str:
    """Write the archive of ``pages`` (page_id, url, html) into the folder."""
    block = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    d = pages.select("page_id", "url", block.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    # a small payload's records are all responses and meet it in parts; of a larger one there is a single response
    parts = F.when(F.col("size") < least, F.ceil(F.col("records") / rows_a_part)).otherwise(1).cast("int").alias("parts")
    other = F.struct("size", F.sha2("payload", 512))
    once = d.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(other).alias("lo"), F.max(other).alias("hi"), F.count(F.lit(1)).alias("records"), F.max("size").alias("size"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("different payloads of digest "), F.col("digest"))).cast("binary"))
    with writing(pages.sparkSession):
        once.select("digest", parts, same.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    slim = cut(d.select("page_id", "url", "digest", "size"), "warc-slim")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("keep"), F.count(F.lit(1)).alias("records"))
    response = (F.col("size") < least) | F.col("page_id").eqNullSafe(F.col("keep"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _record(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), _record(F.col("keep")))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(response, F.col("size")).otherwise(0).cast("string")),
    )
    joined = slim.join(first, "digest").withColumn("header", F.concat(lines, F.lit(_END)).cast("binary")).select("*", parts)
    part = F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int")
    with writing(pages.sparkSession):
        joined.select("page_id", "digest", part.alias("part"), "header").write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def _field(head: Column, name: str, value: str) -> Column:
    return F.regexp_extract(head, f"\r\n{name}: {value}(?:\r\n|$)", 1)


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: digest (where the block was found), record (header, block and the two line breaks that end it)."""
    headers = spark.read.schema(_HEADERS).parquet(f"{path}/headers")
    payloads = spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads")
    revisit = _field(F.col("header").cast("string"), "WARC-Type", "([a-z]+)") == "revisit"
    end = F.lit(_END.encode())
    blocks = payloads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    full = headers.filter(~revisit).join(blocks, ["digest", "part"]).select("digest", F.concat("header", "payload", end).alias("record"))
    return full.unionByName(headers.filter(revisit).select("digest", F.concat("header", end).alias("record")))


def parse(records: DataFrame) -> DataFrame:
    """From the bytes of each record: page_id, record_type, refers_to, declared (the header's digest), block, block_digest (computed anew).

    A record whose length or, for responses, digest is not what its header says fails the job.
    """
    head = F.substring_index(F.col("record").cast("string"), _END, 1)
    d = records.select("record", head.alias("head"))
    length = _field(F.col("head"), "Content-Length", "([0-9]+)").cast("int")
    start = F.octet_length("head") + len(_END)
    d = d.withColumns({"length": length, "start": start}).withColumn("block", F.substring(F.col("record"), F.col("start") + 1, F.col("length")))
    d = d.select(
        F.nullif(_field(F.col("head"), "WARC-Record-ID", "<urn:page:(-?[0-9]+)>"), F.lit("")).cast("long").alias("page_id"),
        _field(F.col("head"), "WARC-Type", "([a-z]+)").alias("record_type"),
        F.nullif(_field(F.col("head"), "WARC-Refers-To", "<urn:page:(-?[0-9]+)>"), F.lit("")).cast("long").alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("declared"),
        "block",
        F.sha2("block", 256).alias("block_digest"),
        (F.octet_length("record") == F.col("start") + F.col("length") + len(_END)).alias("whole"),
    )
    right = F.col("whole") & ((F.col("record_type") == "revisit") | (F.col("block_digest") == F.col("declared")))
    wrong = F.raise_error(F.concat(F.lit("record differs from its header: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).cast("string")
    return d.withColumn("block_digest", F.when(right, F.col("block_digest")).otherwise(wrong)).drop("whole")


def resolve(parsed: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record: a revisit has those of the full payload that it refers to."""
    found = cut(parsed.select("page_id", "record_type", "refers_to", "declared", F.octet_length("block").cast("long").alias("bytes"), "block_digest"), "warc-parsed")
    responses = found.filter("record_type = 'response'")
    of = responses.select("declared", F.col("bytes").alias("payload_bytes"), F.col("block_digest").alias("payload_digest")).distinct()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("block_digest").alias("payload_digest"), "record_type", "refers_to")
    return own.unionByName(found.filter("record_type = 'revisit'").join(of, "declared").select(*columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archive to a new shared folder, rebuild the bytes of every record from it, and read those."""
    spark = pages.sparkSession
    return resolve(parse(reconstruct(spark, archive(pages, scratch(spark, "warc")))))

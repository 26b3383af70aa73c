"""Shared pieces of the training-data operators: tables, shared scratch, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text whose words are hashed at once; bounds a worker's memory.
BLOCK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new one where it is unset (local runs)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="gristmill-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder. Its files may go once the results read from them are written."""
    return f"{shared_dir(spark)}/gristmill-{name}-{uuid.uuid4().hex}"


#: While a table is written: shuffle files go as soon as the write ends, as nothing reads them again; and a join with a
#: short written table lets Catalyst build a Bloom filter of it, of at most 8 MB, that rows are held against before they are shuffled.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1PB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "67108864",
}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Within it the settings above hold; those of the session are put back."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there, and lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    with writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()[:1]}:
            there = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


#: A row's locator: the file that it stands in and its number there.
AT = ["_at_file", "_at_row"]


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with each row's locator, which is the same however files are split.

    Rows that don't come straight from files are written to the shared folder first.
    """
    where = [F.col("_metadata.file_path").alias(AT[0]), F.col("_metadata.row_index").alias(AT[1])]
    try:
        return docs.select(*docs.columns, *where)
    except AnalysisException:
        return cut(docs, "located").select(*docs.columns, *where)


def hash_bucket(key: Column, n: int) -> Column:
    """0 to n - 1 from the first 32 bits of the key's MD5; DuckDB has the same (``bucket_sql``)."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def bucket_sql(key: str, n: int) -> str:
    return f"(('0x' || substr(md5(({key})::VARCHAR), 1, 8))::BIGINT % {n})"


# --- word hashes, vectorised over bytes -------------------------------------------------


def _word_bytes() -> np.ndarray:
    """0 for separators; ASCII letters lower-cased, digits and all bytes of other characters as they are."""
    codes = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c.isascii() and c.isalnum():
            codes[b] = ord(c.lower()) if b < 0x80 else b
    return codes


WORD_BYTES = _word_bytes()
BYTE_KEYS = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
POWERS = np.cumprod(np.full(1 << 12, np.uint64(0x5851F42D4C957F2D)))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def segment_hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment of ``codes``; segments begin at ``starts`` and fill the array."""
    lengths = np.diff(np.append(starts, len(codes)))
    at = np.arange(len(codes)) - np.repeat(starts, lengths)
    return mix64(np.add.reduceat(BYTE_KEYS[codes] * POWERS[at & 4095], starts))


def _block_words(raw: np.ndarray) -> np.ndarray:
    codes = WORD_BYTES[raw]
    inside = codes > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if not first.any():
        return np.empty(0, np.uint64)
    return segment_hashes(codes[inside], np.flatnonzero(first[inside]))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words (runs of letters and digits, lower case), in order; whole text, block by block."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= BLOCK:
        return _block_words(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and WORD_BYTES[raw[end]]:  # never cut inside a word
            end += 1
        out.append(_block_words(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words in order; of the whole text where it is shorter; none where it has no words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = out * _PRIME + words[i : n - width + 1 + i]
    return mix64(out ^ np.uint64(width))

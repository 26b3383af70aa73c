"""Operator 10: training-order materialisation of token ids into fixed-stride binary shards.

Documents are tokenised once, into a written table, and laid end to end in the order of their files and rows, each ended by END, in sequences of ``length`` ids; the
last sequence of all is filled up with PAD. That order, and so every byte of the shards, does not depend on how files are split or on what runs where.
Sequence i of the n has the global slot ``permute(i)``, a keyed Feistel network over the least even power of two that holds n, walked
until it lands below n: a bijection of [0, n) that any worker computes alone, with no shuffle
table. Slots are dealt out in ranges: a partition holds whole shards, neighbouring ones if there are more than ``most_parts``, none shares
one with another, and it writes them in order. A slot's shard and place follow by division, so a reader seeks to any slot and resumes
there. A sequence that is not whole when it is written fails the
job rather than write a wrong shard. A shard file is written under a temporary name and
renamed, so a task that runs again leaves the same file.

Cases: null and empty texts are one END; n = 0 writes nothing; rows that repeat, with their doc_id or without one, are laid out each on its
own; very long texts span many sequences; an empty table gives an empty index; other columns play no part.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import AT, drop, located, scratch, writing

PAD = 50256
MAGIC = b"GMSHARD1"
HEADER = 32
ROUNDS = 6
TOKENS = "file string, run long, at long, n int, doc_id long, ids binary"
PARTS = "slot long, offset int, doc_ids array<long>, ids binary"
INDEX = "slot long, shard int, byte_offset long, length int, ids_crc32 long, doc_ids array<long>"


def _round_keys(key: str) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(key.encode()).digest() * 2, "<u8")[:ROUNDS].copy()


def permute(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """The slots of the given sequence numbers in [0, n): keyed Feistel rounds, walked until within range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _round_keys(key)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            x = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x >> np.uint64(32)) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def tokenise(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Written table of file, run, at, n, doc_id, ids: a run is what a task reads of a file, known by its first row; at is where the document's ids begin in it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, run, at = None, -1, 0, 0
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            held = 0
            for doc, text, file, row in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if file != now or row <= last:
                    now, run, at = file, row, 0
                last = row
                ids = tokens.encode(text.as_py(), vocabulary)
                for column, x in zip(out, (file, run, at, len(ids), doc, ids.astype("<u2").tobytes())):
                    column.append(x)
                at, held = at + len(ids), held + len(ids)
                if held > 1 << 22:
                    yield _batch(out, TOKENS)
                    out, held = [[] for _ in out], 0
            yield _batch(out, TOKENS)

    path = scratch(docs.sparkSession, "tokens")
    d = located(docs.select("doc_id", "text")).select("doc_id", "text", *AT)
    d.mapInArrow(each, TOKENS).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)
    return docs.sparkSession.read.schema(TOKENS).parquet(path)


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def write(docs: DataFrame, path: str, *, key: str = "order-1", length: int = 2048, per_shard: int = 2048, most_parts: int = 20_000, vocabulary: str | None = None) -> DataFrame:
    """Write the shards into the folder; the index, a row a sequence: slot, shard, byte_offset, length, ids_crc32, doc_ids."""
    spark = docs.sparkSession
    laid = tokenise(docs, vocabulary or tokens.default_path())
    runs = sorted((r.file, r.run, r.n) for r in laid.groupBy("file", "run").agg(F.sum("n").alias("n")).collect())  # a row an input split
    ids = sum(n for _, _, n in runs)
    total = -(-ids // length)
    begin = np.cumsum([0, *(n for _, _, n in runs)]).tolist()
    begins = spark.sparkContext.broadcast({(file, run): at for (file, run, _), at in zip(runs, begin)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of sequences, those of neighbouring documents in one row, compressed."""
        small = zstandard.ZstdCompressor(level=3)
        for b in batches:
            parts: list[list] = []  # sequence, offset, documents, ids
            end = None
            for file, run, at, doc, raw in zip(*(b.column(c).to_pylist() for c in ("file", "run", "at", "doc_id", "ids"))):
                start, n, done = begins.value[file, run] + at, len(raw) // 2, 0
                while done < n:
                    number, offset = divmod(start + done, length)
                    some = min(length - offset, n - done)
                    if offset and end == start + done:
                        parts[-1][2].append(doc)
                        parts[-1][3] += raw[2 * done : 2 * (done + some)]
                    else:
                        parts.append([number, offset, [doc], bytearray(raw[2 * done : 2 * (done + some)])])
                    done += some
                    end = start + done
                if len(parts) > 4096:  # the last may go on
                    yield _parts(parts[:-1], total, key, small)
                    parts = parts[-1:]
            if parts:
                yield _parts(parts, total, key, small)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = None, None
        slot, held, own = None, [], []

        def whole() -> list:
            """Write the record in hand; its row of the index."""
            nonlocal out, now
            shard, raw = slot // per_shard, b"".join(held)
            if shard != now:
                if out:
                    out.close()
                now, out = shard, ShardWriter(path, shard, length, min(per_shard, total - shard * per_shard))
            return [slot, shard, out.put(slot - shard * per_shard, raw), len(raw) // 2, zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes()), list(dict.fromkeys(own))]

        big = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for at, offset, docs_of, raw in zip(*(b.column(c).to_pylist() for c in ("slot", "offset", "doc_ids", "ids"))):
                if at != slot:
                    if slot is not None:
                        rows.append(whole())
                    slot, held, own = at, [], []
                if offset != sum(map(len, held)) // 2:
                    raise RuntimeError(f"a part of the sequence at slot {at} is missing")
                held.append(big.decompress(raw))
                own += docs_of
            yield _batch([list(c) for c in zip(*rows)] or [[] for _ in range(6)], INDEX)
        if slot is not None:
            yield _batch([[x] for x in whole()], INDEX)
        if out:
            out.close()

    shards = max(1, -(-total // per_shard))
    wide = -(-shards // most_parts)  # shards of a partition
    found = scratch(spark, "shard-index")
    with writing(spark):
        placed = laid.mapInArrow(deal, PARTS).withColumn("part", F.expr(f"int(slot div {wide * per_shard})"))
        placed = placed.repartitionById(-(-shards // wide), "part").sortWithinPartitions("slot", "offset").select("slot", "offset", "doc_ids", "ids")
        placed.mapInArrow(store, INDEX).write.parquet(found)
    drop(laid)
    _sweep(path)
    return spark.read.schema(INDEX).parquet(found)


def _sweep(path: str) -> None:
    """Delete what attempts that failed have left."""
    from pyarrow import fs

    files, folder = _store(path)
    for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.base_name.startswith(".shard-"):
            files.delete_file(f.path)


def _parts(parts: list[list], total: int, key: str, small) -> pa.RecordBatch:
    slots = permute(np.array([p[0] for p in parts]), total, key).tolist()
    return _batch([slots, [p[1] for p in parts], [p[2] for p in parts], [small.compress(bytes(p[3])) for p in parts]], PARTS)


def _store(path: str):
    """File system and path of a folder's address; any that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


class ShardWriter:
    """Records in order of their place, each of ``length`` 16-bit ids, after a header of HEADER bytes."""

    def __init__(self, path: str, shard: int, length: int, records: int):
        self.files, self.folder = _store(path)
        self.files.create_dir(self.folder)
        self.name, self.temporary = f"{self.folder}/{_name(shard)}", f"{self.folder}/.{_name(shard)}-{uuid.uuid4().hex}"
        self.length, self.records, self.next = length, records, 0
        self.out = self.files.open_output_stream(self.temporary)
        self.out.write(MAGIC + np.array([length, 2, records], "<u8").tobytes())

    def put(self, place: int, ids: bytes) -> int:
        if place != self.next:
            raise RuntimeError(f"record {self.next} of {self.name} is missing")
        self.next += 1
        self.out.write(ids + np.full(self.length - len(ids) // 2, PAD, "<u2").tobytes())
        return HEADER + place * self.length * 2

    def close(self) -> None:
        self.out.close()
        if self.next != self.records:
            raise RuntimeError(f"{self.name} has {self.next} of {self.records} records")
        self.files.move(self.temporary, self.name)


def read(path: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """Records from slot ``start`` on, in training order, shard after shard; a reader that stopped resumes at its next slot."""
    files, folder = _store(path)
    shard, first = 0, 0
    while files.get_file_info(f"{folder}/{_name(shard)}").is_file:
        with files.open_input_file(f"{folder}/{_name(shard)}") as f:
            head = f.read(HEADER)
            if head[:8] != MAGIC:
                raise ValueError(f"not a shard: {_name(shard)}")
            length, width, records = map(int, np.frombuffer(head[8:], "<u8"))
            at = max(start - first, 0)
            if at < records:
                f.seek(HEADER + at * length * width)
            for i in range(at, records):
                if stop is not None and first + i >= stop:
                    return
                yield np.frombuffer(f.read(length * width), "<u2")
        shard, first = shard + 1, first + records


def check(index: DataFrame, path: str, length: int = 2048) -> DataFrame:
    """Read every record back at its offset: the index with ``read_crc32``, of the ids as they are in the shards."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _store(path)
        now, f = None, None
        for b in batches:
            sums = []
            for shard, at, n in zip(*(b.column(c).to_pylist() for c in ("shard", "byte_offset", "length"))):
                if shard != now:
                    f, now = files.open_input_file(f"{folder}/{_name(shard)}"), shard
                f.seek(at)
                sums.append(zlib.crc32(np.frombuffer(f.read(n * 2), "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.int64())], names=[*b.schema.names, "read_crc32"])

    schema = type(index.schema)([*index.schema.fields]).add("read_crc32", "long")
    return index.mapInArrow(each, schema)


def materialise(docs: DataFrame, **options) -> DataFrame:
    """Write shards into a new shared folder and read them all back."""
    path = scratch(docs.sparkSession, "shards")
    return check(write(docs, path, **options), path)

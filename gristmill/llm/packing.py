"""Operator 7: best-two-fit packing of documents into sequences of at most ``size`` tokens.

Lengths are whole numbers up to ``size``, so the packing works on their histogram, ``size`` rows
however many documents there are: a bin is filled greedily with the longest pieces that fit, then
its smallest piece gives way to the two unpacked pieces that fill the widened gap best. A pattern
repeats as often as the counts allow, so packing all bins takes a step for each pattern, not for
each bin. Pieces then find their place by their rank among pieces of their length, counted in
two levels, in as many cells as a length needs, so that no length is one task. One packing of all documents, the same in every run.

Cases: null text counts as empty; an empty text is one piece of one token; documents longer than
``size`` are cut into pieces of ``size`` with the shorter piece first, very long ones into as many as it takes; of pieces of one length which goes where
does not matter; rows that repeat, with their doc_id or without one, are packed each on its own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_starts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of ``size`` but the first, which may be shorter."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))] if n else []


def pieces(docs: DataFrame, size: int = 2048, *, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut the long ones: a row a piece, with the ids themselves if asked."""
    path = path or tokens.default_path()
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.encode(text.as_py(), path)
                for k, (start, n) in enumerate(piece_starts(len(ids), size)):
                    own = ids[start : start + n]
                    for column, x in zip(out, (doc, k, start, n, zlib.crc32(own.tobytes()), own.astype(np.int32))):
                        column.append(x)
                    held += n
                if with_ids and held > 1 << 20:
                    yield _batch(out, with_ids)
                    out, held = [[] for _ in out], 0
            yield _batch(out, with_ids)

    return docs.select("doc_id", "text").mapInArrow(cut_up, schema)


def _batch(columns: list[list], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def best_two_fit(counts: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Pack a histogram (counts[l] pieces of length l): (times, [(length, number), ...]) for each pattern in turn."""
    left = np.asarray(counts, np.int64).copy()
    steps = np.arange(size + 1)
    out = []
    while True:
        fits = np.maximum.accumulate(np.where(left > 0, steps, 0))  # the longest left of at most l
        if not fits[size]:
            return out
        gap, items = size, {}
        while gap and (l := int(fits[gap])):
            take = min(int(left[l]), gap // l)
            items[l] = take
            left[l] -= take
            gap -= take * l
            if not left[l]:
                fits = np.maximum.accumulate(np.where(left > 0, steps, 0))
        if gap:
            small = min(items)
            pair = _best_pair(left, fits, gap + small)
            if pair and sum(pair) > small:
                items[small] -= 1
                left[small] += 1
                for l in pair:
                    items[l] = items.get(l, 0) + 1
                    left[l] -= 1
        items = {l: n for l, n in items.items() if n}
        more = min(int(left[l]) // n for l, n in items.items())
        for l, n in items.items():
            left[l] -= more * n
        out.append((1 + more, sorted(items.items(), reverse=True)))


def _best_pair(left: np.ndarray, fits: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two unpacked pieces whose lengths add up to the most within the gap."""
    long = np.flatnonzero(left[: gap + 1])
    if not len(long):
        return None
    upto = np.minimum(gap - long, long)
    short = fits[upto]
    alone = (short == long) & (left[long] < 2)
    short = np.where(alone, fits[np.maximum(np.minimum(upto, long - 1), 0)], short)
    both = np.where(short > 0, long + short, 0)
    best = int(both.argmax())
    return (int(long[best]), int(short[best])) if both[best] else None


def places(patterns: list[tuple[int, list[tuple[int, int]]]], size: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, place): ranks from one row to the next take a sequence each."""
    rows: dict[int, list] = {}
    taken = np.zeros(size + 1, np.int64)
    sequence = 0
    for times, items in patterns:
        at = 0
        for l, n in items:
            for _ in range(n):
                rows.setdefault(l, []).append((taken[l], sequence, at))
                taken[l] += times
                at += l
        sequence += times
    return {l: np.array(x, np.int64) for l, x in rows.items()}


def pack(cut_up: DataFrame, size: int = 2048, *, cell_rows: int = 1024) -> DataFrame:
    """Give every piece (a table that is read three times) its sequence_id and offset. Pieces of a length are ranked in cells of about ``cell_rows``."""
    spark, counts = cut_up.sparkSession, np.zeros(size + 1, np.int64)
    for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``size`` rows
        counts[r.length] = r.n
    cells = spark.createDataFrame([(l, max(1, math.ceil(int(counts[l]) / cell_rows))) for l in map(int, np.flatnonzero(counts))], "length long, _cells long")
    d = cut_up.join(F.broadcast(cells), "length").withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("_cells"))).drop("_cells")
    counted = d.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    found = spark.sparkContext.broadcast(places(best_two_fit(counts, size), size))  # bounded by size * patterns
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("length", "_cell", "_before")
    rank = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "start"))
    ranked = d.join(offsets, ["length", "_cell"]).withColumn("_rank", F.col("_before") + rank - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for l in np.unique(lengths):
                own, at = found.value[int(l)], np.flatnonzero(lengths == l)
                row = own[np.searchsorted(own[:, 0], ranks[at], side="right") - 1]
                sequence[at], offset[at] = row[:, 1] + ranks[at] - row[:, 0], row[:, 2]
            keep = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = cut_up.schema
    own = [f.name for f in schema]
    schema = type(schema)([*schema.fields]).add("sequence_id", "long").add("offset", "long")
    return ranked.select(*own, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, size: int = 2048, *, path: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(cut(pieces(docs, size, path=path, with_ids=with_ids), "pieces"), size)

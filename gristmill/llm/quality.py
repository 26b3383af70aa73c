"""Operator 1: quality classifier, ordinal cumulative-link regression over hashed text.

Ratings are graded 0 (poor), 1 (sound but toxic), 2 (sound). One weight vector over hashed features
is shared by all grades and ordered thresholds cut its score: P(grade >= k) = sigmoid(s - t_k).
Features of a blank-separated token: its letters and digits in lower case, its shape (classes
of characters, runs as one), and whether it repeats the token before; each family's counts
are square-rooted and scaled to length one. The fit takes a sample of at most ``per_grade``
labelled rows of each grade, by hash of the identifier, weighted back to the grades' shares
among all labels, and of those, in the same order, only as many as ``most_bytes`` of features hold; scoring reads every document whole.

Cases: null and empty texts have no features and score 0; very long texts are read whole, block by block; rows that repeat score alike, and count once in the fit; of
a doc_id's different texts the one with the smallest features counts; ties at the threshold are kept; an empty table gives an empty result;
ids without a label are scored only; a label that disagrees with another counts with the
lower quality and the higher toxicity; with labels of one grade or none, nothing is rejected;
other columns are left alone, those with the
answer's names replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, WORD_BYTES, cut, mix64, segment_hashes

BITS = 18
FAMILIES = np.array([0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F], np.uint64)
GRADES = 3


def _shape_bytes() -> np.ndarray:
    """Letters by case, digits as one, other characters as themselves, blanks 0."""
    codes = np.arange(256).astype(np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or "a" <= c <= "z":
            codes[b] = 97
        elif "A" <= c <= "Z":
            codes[b] = 65
        elif "0" <= c <= "9":
            codes[b] = 48
        elif c in " \t\n\v\f\r":
            codes[b] = 0
    return codes


SHAPE_BYTES = _shape_bytes()


def _token_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letters and of the shape of each token."""
    shape = SHAPE_BYTES[raw]
    inside = shape > 0
    if not inside.any():
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    token = (np.cumsum(first) - 1)[inside]
    n = int(token[-1]) + 1
    shape, raw, first = shape[inside], raw[inside], first[inside]
    turn = first.copy()
    turn[1:] |= shape[1:] != shape[:-1]
    shapes = segment_hashes(shape[turn], np.flatnonzero(first[turn]))
    letters = WORD_BYTES[raw] > 0
    words = np.zeros(n, np.uint64)
    if letters.any():
        own = token[letters]
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        words[own[begins]] = segment_hashes(WORD_BYTES[raw[letters]], begins)
    return words, shapes


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and values of a whole text, read block by block."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and SHAPE_BYTES[raw[end]]:
            end += 1
        found.append(_token_hashes(raw[at:end]))
        at = end
    words, shapes = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64),) * 2
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    again = np.append(False, (words[1:] == words[:-1]) & (words[1:] > 0)).astype(np.uint64)
    at, values = [], []
    for k, family in enumerate((words, shapes, again)):
        buckets = (mix64(family + FAMILIES[k]) >> np.uint64(64 - bits)).astype(np.int64)
        own, counts = np.unique(buckets, return_counts=True)
        at.append(own)
        values.append(np.sqrt(counts / len(words)))
    return np.concatenate(at), np.concatenate(values).astype(np.float32)


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        at, x = features(text)
        return float(self.weights[at] @ x)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - np.asarray(scores, np.float64)[:, None]))


def fit(at: list[np.ndarray], x: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, *, bits: int = BITS, steps: int = 200, rate: float = 0.3, ridge: float = 1e-4) -> Ordinal:
    """Maximum likelihood with a ridge penalty, by Adam over all rows at once; the same in every run."""
    n, size = len(grades), 1 << bits
    lengths = np.array([len(a) for a in at])
    full = np.flatnonzero(lengths)
    cols, vals = np.concatenate(at) if n else np.empty(0, np.int64), np.concatenate(x) if n else np.empty(0)
    used, cols = np.unique(cols, return_inverse=True)
    starts = (np.cumsum(lengths) - lengths)[full]
    row = np.repeat(np.arange(n), lengths)
    weight = weight / weight.sum()
    share = np.array([weight[grades >= k].sum() for k in range(1, GRADES)]).clip(1e-4, 1 - 1e-4)
    theta = -np.log(share / (1 - share))
    # thresholds are t_1 and the logarithms of the steps to the next, so they stay in order
    par = np.concatenate([np.zeros(len(used)), theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    d = len(used)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        s = np.zeros(n)
        if len(full):
            s[full] = np.add.reduceat(par[:d][cols] * vals, starts)
        gaps = np.exp(par[d + 1 :])
        t = par[d] + np.append(0, np.cumsum(gaps))
        upper = np.column_stack([np.ones(n), sig(s[:, None] - t[None, :])])  # P(grade >= k)
        lower = np.column_stack([upper[:, 1:], np.zeros(n)])
        i = np.arange(n)
        p = np.maximum(upper[i, grades] - lower[i, grades], 1e-9)
        du, dl = upper[i, grades] * (1 - upper[i, grades]), lower[i, grades] * (1 - lower[i, grades])
        gs = -weight * (du - dl) / p
        gt = np.zeros(GRADES - 1)
        np.add.at(gt, grades[grades > 0] - 1, (weight * du / p)[grades > 0])
        np.add.at(gt, grades[grades < GRADES - 1], -(weight * dl / p)[grades < GRADES - 1])
        g = np.concatenate([np.bincount(cols, vals * gs[row], d) + ridge * par[:d], [gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        par = par - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = par[:d]
    return Ordinal(weights, par[d] + np.append(0, np.cumsum(np.exp(par[d + 1 :]))))


def train(docs: DataFrame, labels: DataFrame, *, per_grade: int = 1000, most_bytes: int = 1 << 28) -> Ordinal:
    """Fit on at most ``per_grade`` labelled documents of each grade and ``most_bytes`` of features, which alone come to the driver."""
    spark = docs.sparkSession
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    graded = one.select("doc_id", F.when(F.col("q") <= 0, 0).when(F.col("t") > 0, 1).otherwise(2).alias("grade"))
    total = {r.grade: r["count"] for r in graded.groupBy("grade").count().collect()}  # a row a grade
    empty = Ordinal(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, -40.0))
    if len(total) < 2:
        return empty
    ids = [graded.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade).collect() for g in sorted(total)]
    sample = spark.createDataFrame([(r.doc_id, r.grade) for part in ids for r in part], "doc_id long, grade int")  # at most GRADES * per_grade rows
    schema = "doc_id long, grade int, at binary, x binary"

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())], names=["doc_id", "grade", "at", "x"])

    made = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text").mapInArrow(featurise, schema)
    found = cut(made.groupBy("doc_id").agg(F.min(F.struct("x", "at", "grade")).alias("r")).select("doc_id", "r.*"), "quality-features")  # a row a document of the sample
    held, bytes_ = [], 0
    for r in found.select("doc_id", (F.octet_length("x") + F.octet_length("at")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        bytes_ += r.n
        if bytes_ <= most_bytes:
            held.append(r.doc_id)
    rows = sorted(found.filter(F.col("doc_id").isin(held)).collect(), key=lambda r: r.doc_id)
    if len({r.grade for r in rows}) < 2:
        return empty
    grades = np.array([r.grade for r in rows])
    weight = np.array([total[g] for g in range(GRADES) if g in total], float)
    weight = dict(zip(sorted(total), weight / [max(1, (grades == g).sum()) for g in sorted(total)]))
    return fit([np.frombuffer(r.at, "<i4").astype(np.int64) for r in rows], [np.frombuffer(r.x, "<f4").astype(np.float64) for r in rows], grades, np.array([weight[g] for g in grades]))


def rate(docs: DataFrame, model: Ordinal, *, min_grade: int = 1, min_tail: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with score, p_ge_1, p_ge_2, expected_grade and kept (P(grade >= min_grade) >= min_tail)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 2^BITS floats
    docs = docs.select([c for c in docs.columns if c not in ("score", "p_ge_1", "p_ge_2", "expected_grade", "kept", "_text")])  # these are the answer's
    schema = type(docs.schema)([*docs.schema.fields]).add("score", "double").add("p_ge_1", "double").add("p_ge_2", "double").add("expected_grade", "double").add("kept", "boolean")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*shared.value)
        for b in batches:
            scores = np.array([own.score(t.as_py()) for t in b.column("_text")], np.float64)
            tails = own.tails(scores) if len(scores) else np.empty((0, GRADES - 1))
            new = [scores, tails[:, 0], tails[:, 1], tails.sum(axis=1), tails[:, min_grade - 1] >= min_tail]
            keep = [c for c in b.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, new)], names=[f.name for f in schema])

    return docs.withColumn("_text", F.col("text")).mapInArrow(judge, schema)

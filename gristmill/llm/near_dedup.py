"""Operator 4: near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its runs of five words (letters and digits, lower case); a shingle's weight is its count
in the text times its inverse document frequency, the logarithm log2(N / df) in whole steps: 8 for a shingle in
at most one of 256 documents, one less for each doubling of the documents that hold it, 1 for one in half of all or more.

A family of near copies counts about once in df, else what a thousand copies share would weigh less than
what each has alone, and copies that share nine tenths of their text would fall below the threshold. df is therefore the *effective* number
of documents: n documents hold the shingle, and those with the same smallest shingle hash (near copies have that in common
as often as they are similar) count as one family; n^2 / sum of squared family sizes is n where all differ and close to 1 where
all are copies. The sum of squares comes from SKETCHES signed sums (Alon, Matias and Szegedy), so a shingle takes
a fixed number of counters, in 2^DF_BITS hashed buckets, whatever the size of the corpus.

``BANDS * ROWS`` consistent weighted samples a text are kept as 16 bits each (its sketch) and cut into bands: a pair at the threshold shares a band
with probability 0.9993, a pair at a third with 0.03. Texts with equal words are one class from the start. Then:

1. In every bucket of a band the text with the smallest doc_id is the centre, mostly one for all bands of a group, and each other text makes a pair with it.
2. Pairs whose sketches agree in fewer samples than a pair at the threshold would with probability 1 - 1e-9 are screened out; no texts are moved for that.
3. The others are compared by weighted Jaccard similarity of the whole texts. A centre's text travels once for
   ``chunk`` members; links make components.
4. Where texts of a bucket are still in different components, their sketches are held against each other,
   block against block. Where few pairs pass, those are compared; where many do, the texts that are
   concerned meet in blocks, each text once a block. So every pair that shares a band is compared, screened out, or already joined.

Cases: null, empty and wordless texts are each a class of their own; a text of fewer than five
words is one shingle; very long texts are read whole; ties between centres do not change classes; rows that repeat a doc_id are one document, of the
words with the smallest digest, and are kept or dropped together; rows without doc_id are kept and in no class; a corpus of fewer
than 256 documents counts as 256 in the frequencies; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, mix64, shingles, word_hashes
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 6
DF_BITS, SKETCHES = 18, 6
#: Weights are 1 to LEVELS; a shingle in one of 2^LEVELS documents has the greatest.
LEVELS = 8
#: A pair at the threshold agrees in this many standard deviations fewer samples once in 1e9 times.
DEVIATIONS = 6
_POOL = 1 << 16
_CHUNK = 512
_rng = np.random.default_rng(20260202)
_MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_R, _C = _rng.gamma(2, 1, _POOL), _rng.gamma(2, 1, _POOL)
_BETA = _rng.random(_POOL)


def weigh(text: str | None, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; sorted distinct shingles; their counts."""
    words = word_hashes(text)
    own, counts = np.unique(shingles(words, k), return_counts=True)
    return words, own, counts


def bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - DF_BITS)).astype(np.int64)


def signs(key: np.uint64) -> np.ndarray:
    """+1 or -1 for each sketch, from a family's key."""
    bits = int(mix64(np.array([key ^ np.uint64(0x5851F42D4C957F2D)]))[0])
    return np.array([1 - 2 * (bits >> i & 1) for i in range(SKETCHES)], np.int32)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Weights of the buckets, 1 to LEVELS, from the effective number of documents in each."""
    names = ["bucket", "n", *(f"s{i}" for i in range(SKETCHES))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((1 << DF_BITS, 1 + SKETCHES), np.int32), 0
        for b in batches:
            for text in b.column(0):
                _, own, _ = weigh(text.as_py())
                if not len(own):
                    continue
                n += 1
                at = bucket(own)  # in order, as the shingles are
                total[at[np.append(True, at[1:] != at[:-1])]] += np.append(1, signs(own[0])).astype(np.int32)
        at = np.flatnonzero(total[:, 0])
        rows = np.vstack([np.column_stack([at, total[at]]), [[-1, n] + [0] * SKETCHES]])
        for i in range(0, len(rows), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + (1 << 16), c]) for c in range(len(names))], names=names)

    rows = docs.select("text").mapInArrow(count, ", ".join(f"{c} long" for c in names))
    rows = cut(rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names[1:])), "near-frequencies").toArrow()  # at most 2^DF_BITS + 1 rows
    return levels(*(rows[c].to_numpy() for c in ("bucket", "n")), np.column_stack([rows[c].to_numpy() for c in names[2:]]))


def levels(at: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Weights from the counts of the buckets (-1: of all documents)."""
    all_docs = max(1 << LEVELS, int(n[at == -1].sum()))
    effective = np.clip(n.astype(float) ** 2 / np.maximum((sketch.astype(float) ** 2).mean(axis=1), 1), 1, np.maximum(n, 1))
    out = np.full(1 << DF_BITS, LEVELS, np.uint8)
    out[at[at >= 0]] = np.clip(np.rint(np.log2(all_docs / effective[at >= 0])), 1, LEVELS)
    return out


@lru_cache(maxsize=64)
def _samples(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Ioffe's sampling for a whole weight, for each drawing of (r, c, beta): ln a and t."""
    log = np.log(weight)
    t = np.floor(log / _R + _BETA)
    return (np.log(_C) - _R * (t - _BETA) - _R).astype(np.float32), t.astype(np.int64)


def signature(own: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """BANDS * ROWS consistent weighted samples of a weighted set, each hashed to 64 bits."""
    h = len(_MULTIPLIERS)
    best, key, step = np.full(h, np.inf, np.float32), np.zeros(h, np.uint64), np.zeros(h, np.int64)
    lane = np.arange(h)
    for w in np.unique(weights):
        a, t = _samples(int(w))
        part = own[weights == w]
        for at in range(0, len(part), _CHUNK):
            some = part[at : at + _CHUNK]
            draw = _MULTIPLIERS[:, None] * some[None, :]
            draw >>= np.uint64(48)
            draw = draw.view(np.int64)
            values = a.take(draw, mode="clip")
            i = values.argmin(axis=1)
            low, k = values[lane, i], some[i]
            better = (low < best) | ((low == best) & (k < key))
            best, key, step = np.where(better, low, best), np.where(better, k, key), np.where(better, t[draw[lane, i]], step)
    return mix64(key ^ mix64(step.astype(np.uint64) + _MULTIPLIERS))


def band_keys(sketch: str = "sketch"):
    """A sketch's bands, each the hash of its samples and its number."""
    width = 2 * ROWS
    return F.array(*(F.xxhash64(F.substring(sketch, 1 + i * width, width), F.lit(i)) for i in range(BANDS)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], level: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles (distinct, counts)."""
    one, two = (int((n * level[bucket(s)].astype(np.int64)).sum()) for s, n in (a, b))
    if not one or not two:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int((np.minimum(a[1][i], b[1][j]) * level[bucket(a[0][i])].astype(np.int64)).sum())
    return shared / (one + two - shared)


def sign(docs: DataFrame, level) -> DataFrame:
    """(doc_id, hash of the text, digest of the words, weight, sketch) of each row; digest and sketch null where it has no words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, weights, sketches = [], [], []
            for text in b.column(2):
                words, own, counts = weigh(text.as_py())
                if not len(words):
                    digests.append(None), weights.append(0), sketches.append(None)
                    continue
                w = counts * level.value[bucket(own)].astype(np.int64)
                digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                weights.append(int(w.sum()))
                sketches.append((signature(own, w) >> np.uint64(48)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(digests, pa.binary()), pa.array(weights, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "body", "digest", "weight", "sketch"])

    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(each, "doc_id long, body long, digest binary, weight long, sketch binary")


def least_agreement(threshold: float) -> float:
    """The share of samples in which a pair at the threshold agrees, but once in 1e9 times."""
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of samples in which rows of two arrays of sketches agree."""
    return (a == b).mean(axis=-1)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def screen(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule them out."""
    least = least_agreement(threshold)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = agreeing(_sketches(b.column(2)), _sketches(b.column(3))) >= least
                yield b.select(["a", "b"]).filter(pa.array(ok))

    of = lambda x: reps.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("weight").alias(f"weight_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(near("weight_a", "weight_b", threshold)).select("a", "b", "sketch_a", "sketch_b").mapInArrow(pick, "a long, b long")


def texts_of(wanted: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``wanted`` (rep and more columns) with the texts of the documents."""
    wanted = wanted.join(reps.select("rep", "body"), "rep").withColumn("wanted", F.lit(1))
    wanted = cut(wanted, "near-wanted").filter("wanted = 1").drop("wanted")  # written and filtered, so Catalyst can hold texts against it before they are shuffled
    return docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("body"), "text").join(wanted, ["rep", "body"])


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, level, threshold: float, *, chunk: int = 64) -> DataFrame:
    """(a, b, similarity) of the pairs at the threshold or above, by whole texts.

    Members of a centre come in chunks, each behind the centre's text, and are read one by one.
    """
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / chunk))
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    members = pairs.join(sizes, "a").select("a", part.alias("part"), "b")
    centres = members.select("a", "part").distinct()
    roles = members.select(F.col("b").alias("rep"), "a", "part", F.lit(1).alias("role")).unionByName(centres.select(F.col("a").alias("rep"), "a", "part", F.lit(0).alias("role")))
    rows = texts_of(roles, docs, reps).repartition("a", "part").sortWithinPartitions("a", "part", "role", "rep").select("a", "part", "role", "rep", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, last = None, None, None
        for batch in batches:
            out: list[list] = [[], [], []]
            for a, part, role, rep, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "rep")), batch.column("text")):
                if role == 0:
                    if at != (a, part):
                        at, own, last = (a, part), weigh(text.as_py())[1:], None
                elif rep != last:  # else a row that repeats
                    last = rep
                    s = similarity(own, weigh(text.as_py())[1:], level.value)
                    if s >= threshold:
                        for column, v in zip(out, (a, rep, s)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return rows.mapInArrow(compare, "a long, b long, similarity double")


def near(x: str, y: str, threshold: float):
    """The similarity of two multisets is at most the smaller weight over the larger."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(threshold)


def links(docs: DataFrame, reps: DataFrame, level, *, threshold: float = THRESHOLD, block: int = 256) -> DataFrame:
    """(node, component) over documents with different words (reps: rep, body, weight, sketch)."""
    rows = reps.select("rep", "weight", F.explode(band_keys()).alias("key"))
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("a")).filter("n > 1")
    live = cut(rows.join(many, "key").select("key", "n", "rep", "weight", "a"), "near-buckets")
    pairs = live.filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    tested = cut(screen(pairs, reps, threshold), "near-pairs")
    groups = components(cut(verify(tested, docs, reps, level, threshold), "near-links"))
    own = live.select("key", "n", "rep", "weight").join(groups, live["rep"] == groups["node"], "left").select("key", "n", "rep", "weight", F.coalesce("component", "rep").alias("component"))
    split = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    apart = cut(own.join(split, "key", "left_semi"), "near-apart")
    drop(live)
    if apart.isEmpty():
        return groups
    found = cut(candidates(apart, reps, threshold), "near-candidates")
    both = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    more = found.filter("b is not null").select(*both).distinct().join(tested.select(*both), ["a", "b"], "left_anti")
    fresh = verify(cut(more, "near-pairs"), docs, reps, level, threshold)
    many = found.filter("b is null").select("key", F.col("a").alias("rep")).distinct()
    if not many.isEmpty():
        large = apart.drop("n").join(many, ["key", "rep"])
        large = large.join(large.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
        fresh = fresh.unionByName(verify_blocks(cut(large, "near-large"), docs, reps, level, threshold, block))
    return merged(groups, cut(fresh, "near-links"))


def meetings(rows: DataFrame, block: int) -> DataFrame:
    """Rows of buckets (key, n, rep, ...) dealt into blocks of about ``block``, once for each block that their own one meets: i <= j, own."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    d = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def candidates(apart: DataFrame, reps: DataFrame, threshold: float, *, block: int = 2048, sparse: int = 4) -> DataFrame:
    """(key, a, b): pairs of a bucket in different components whose sketches do not rule them out.

    Where there are more than ``sparse`` pairs for each text, the texts alone, with b null.
    """
    least = least_agreement(threshold)
    rows = apart.join(reps.select("rep", "sketch"), "rep")
    rows = meetings(rows, block).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "component", "rep").select("key", "i", "j", "own", "component", "rep", "weight", "sketch")

    def meet(key: int, i: int, j: int, own: np.ndarray, comp: np.ndarray, rep: np.ndarray, weight: np.ndarray, sketch: np.ndarray) -> tuple:
        """comp is in order: what stands in a component is held against what stands behind it."""
        end = np.searchsorted(comp, comp, side="right")
        one, two = [], []
        for k in np.flatnonzero(end < len(comp)):
            rest = np.arange(end[k], len(comp))
            if i != j:
                rest = rest[own[rest] != own[k]]
            rest = rest[np.minimum(weight[rest], weight[k]) >= np.maximum(weight[rest], weight[k]) * threshold]
            rest = rest[agreeing(sketch[rest], sketch[k]) >= least] if len(rest) else rest
            one.append(np.full(len(rest), rep[k]))
            two.append(rep[rest])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (one, two))
        if len(a) > sparse * len(comp):
            a, b = np.unique(np.concatenate([a, b])), None
        return np.full(len(a), key), a, b

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held)
            at = [t[c].to_numpy() for c in ("key", "i", "j")]
            turn = np.flatnonzero(np.append(True, (at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1]) | (at[2][1:] != at[2][:-1])))
            cols = [t[c].to_numpy() for c in ("own", "component", "rep", "weight")] + [_sketches(t["sketch"])]
            found = [meet(*(x[u] for x in at), *(x[u:v] for x in cols)) for u, v in zip(turn, [*turn[1:], t.num_rows])]
            for key, a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())], names=["key", "a", "b"])

        for batch in batches:  # the last group of a batch may go on in the next
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            at = [t[c].to_numpy() for c in ("key", "i", "j")]
            last = np.flatnonzero(~((at[0] == at[0][-1]) & (at[1] == at[1][-1]) & (at[2] == at[2][-1])))
            first = int(last[-1]) + 1 if len(last) else 0
            if held and (first or any(held[-1][c][-1].as_py() != t[c][0].as_py() for c in ("key", "i", "j"))):
                held.append(t.slice(0, first))
                yield from done()
                held = [t.slice(first)]
            elif first:
                held = [t.slice(0, first)]
                yield from done()
                held = [t.slice(first)]
            else:
                held.append(t)
        if held:
            yield from done()

    return rows.mapInArrow(pick, "key long, a long, b long")


def merged(groups: DataFrame, fresh: DataFrame) -> DataFrame:
    """Components (node, component) joined up by further links (a, b): only the components that those touch are gone through again."""
    of = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    ends = fresh.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    again = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    up = again.select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = groups.join(up, groups["component"] == up["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    return moved.unionByName(again.join(groups.select("node"), "node", "left_anti"))


def verify_blocks(apart: DataFrame, docs: DataFrame, reps: DataFrame, level, threshold: float, block: int) -> DataFrame:
    """(a, b, similarity) of a link between any two components of a bucket that have one: blocks of the bucket meet in pairs.

    A text travels once for each block it meets, not once for each text; a task holds two blocks.
    """
    d = texts_of(meetings(apart, block).select("key", "i", "j", "own", "rep", "weight", "component"), docs, reps)

    def compare(part: pa.Table) -> pa.Table:
        i, j = part["i"][0].as_py(), part["j"][0].as_py()
        own, reps, comps = (part[c].to_numpy() for c in ("own", "rep", "component"))
        sets = [weigh(t.as_py())[1:] for t in part["text"]]
        size = np.array([int((n * level.value[bucket(s)].astype(np.int64)).sum()) for s, n in sets])
        # each shingle's holders, then for each text the weight that it shares with every other
        flat = np.concatenate([s for s, _ in sets]) if sets else np.empty(0, np.uint64)
        counts = np.concatenate([n for _, n in sets]) if sets else np.empty(0, np.int64)
        holder = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
        order = np.argsort(flat, kind="stable")
        keys, begin = np.unique(flat[order], return_index=True)
        end = np.append(begin[1:], len(flat))
        holder, held = holder[order], counts[order]
        out: list[list] = [[], [], []]
        joined: set[tuple[int, int]] = set()  # one link joins two components, more add nothing
        for k, (s, n) in enumerate(sets):
            if i != j and own[k] != i:
                continue
            at = np.searchsorted(keys, s)
            spans = end[at] - begin[at]
            take = np.repeat(begin[at] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            w = np.minimum(held[take], np.repeat(n, spans)) * np.repeat(level.value[bucket(s)].astype(np.int64), spans)
            shared = np.bincount(holder[take], w, len(sets))
            similar = shared / np.maximum(size[k] + size - shared, 1)
            ok = (similar >= threshold) & (comps != comps[k]) & ((own == j) if i != j else (np.arange(len(sets)) > k))
            for m in np.flatnonzero(ok):
                two = (min(comps[k], comps[m]), max(comps[k], comps[m]))
                if two in joined:
                    continue
                joined.add(two)
                for column, v in zip(out, (min(reps[k], reps[m]), max(reps[k], reps[m]), similar[m])):
                    column.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return d.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, similarity double")


def classes(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its group), kept (it is that document)."""
    level = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs))  # 2^DF_BITS bytes
    signed = sign(docs, level).filter("digest is not null and doc_id is not null")
    words = cut(signed.groupBy("doc_id").agg(F.min(F.struct("digest", "body", "weight", "sketch")).alias("r")).select("doc_id", "r.*"), "near-signed")
    one = F.min_by(F.struct(F.col("doc_id").alias("rep"), "body", "weight", "sketch"), "doc_id").alias("r")
    reps = cut(words.groupBy("digest").agg(one).select("digest", "r.*"), "near-reps")
    groups = links(docs, reps, level, threshold=threshold)
    known = reps.join(groups, reps["rep"] == groups["node"], "left").select("digest", F.coalesce("component", "rep").alias("class_id"))
    of = words.select("doc_id", "digest").join(known, "digest").select("doc_id", "class_id")
    d = docs.select("doc_id").join(of, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return d.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with one document of each group."""
    gone = classes(docs).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*columns)

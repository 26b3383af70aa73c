"""Operator 3: nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors are one node with the smallest identifiers that an answer can need, so copies
neither cut a graph apart nor gather in one task. Nodes are dealt by hash into shards;
each shard is a graph stored as flat neighbour arrays, one Parquet row a shard. Layers are beginnings of the shard's
node order, which is by hash, so each is a random sample of the one below. A node links to
diverse near nodes among those before it, and back: for a layer's first SEED nodes candidates come from their distance matrix, after
that nodes are inserted in batches, each searched for in the graph so far. Blocks of queries meet every shard, all queries of
a block walking the graph together, and the shards' best are merged. Scores are cosines
in double precision on the original vectors; walks use single precision.

Queries and vectors grow together and every block meets every shard, so what is moved grows with blocks times shards. Up to SPREAD * SEED
vectors a shard holds about SEED; then there are SPREAD shards until each holds ``shard_rows``, so up to that many vectors (4 million)
what is moved grows with the input, and beyond it with its square over ``shard_rows``. The beam grows with the square root of a shard's nodes.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows without vec_id; vectors meet only those of their own length; rows that repeat a vec_id
with its vector count once; ties go to the smaller vec_id; a table without vectors gives an empty
result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LINKS, LINKS_0, CANDIDATES, TOP = 16, 32, 64, 5
#: Nodes that are linked from a distance matrix; shards that are made before any grows larger; nodes inserted at once; most numbers of a walk's marks.
SEED, SPREAD, BATCH, MARKS = 4096, 64, 512, 1 << 26
INDEX = "dim int, shard int, n int, width int, vectors binary, ids binary, sizes binary, neighbours binary"
FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).filter(fine & F.exists("embedding", lambda x: x != 0))


def number_width(rows: DataFrame) -> int:
    """Bytes of a component: 4 of single precision, else 8."""
    return 4 if rows.schema["embedding"].dataType.elementType.typeName() == "float" else 8


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(vector bytes, its ``most`` smallest ids): folded in each task first, so a vector that a third of all rows share stays small."""
    kind = f"<f{number_width(rows)}"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                own = held.setdefault(v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes(), [])
                if i not in own:
                    own.append(i)
                    if len(own) > most:
                        own.remove(max(own))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["vector", "ids"])

    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most)
    return rows.mapInArrow(fold, "vector binary, ids array<long>").groupBy("vector").agg(few.alias("ids"))


def _diverse(near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first (-1: none), those nearer to the node than to any chosen before."""
    n, width = near.shape
    chosen = np.full((n, most), -1, np.int32)
    count = np.zeros(n, np.int64)
    row = np.arange(n)
    for j in range(width):
        c = near[:, j]
        own = far[row, np.maximum(c, 0)]
        others = np.where(chosen >= 0, far[np.maximum(c, 0)[:, None], np.maximum(chosen, 0)], np.inf)
        take = (c >= 0) & (count < most) & (own < others.min(axis=1))
        at = np.flatnonzero(take)
        chosen[at, count[at]] = c[at]
        count[at] += 1
    return chosen


def _layer(x: np.ndarray, most: int) -> np.ndarray:
    """Neighbour array of one layer over vectors of length one, in order of insertion."""
    n = len(x)
    far = (1 - x @ x.T).astype(np.float32)
    before = np.where(np.tri(n, k=-1, dtype=bool), far, np.inf)
    width = min(CANDIDATES, n)
    part = np.argpartition(before, width - 1, axis=1)[:, :width]
    values = np.take_along_axis(before, part, 1)
    order = np.argsort(values, axis=1, kind="stable")
    near = np.take_along_axis(part, order, 1).astype(np.int32)
    near[np.isinf(np.take_along_axis(values, order, 1))] = -1
    del before, part, values, order
    out = _diverse(near, far, min(most, LINKS))
    a, b = np.nonzero(out >= 0)
    heads, tails = np.concatenate([a, out[a, b]]), np.concatenate([out[a, b], a])
    d = far[heads, tails]
    order = np.lexsort((tails, d, heads))
    heads, tails = heads[order], tails[order]
    begin = np.searchsorted(heads, np.arange(n))
    place = np.arange(len(heads)) - begin[heads]
    if len(place) == 0:
        return np.full((n, most), -1, np.int32)
    both = np.full((n, place.max() + 1), -1, np.int32)
    both[heads, place] = tails
    kept = _diverse(both, far, most)
    full = np.full((n, most), -1, np.int32)  # room that is left goes to the nearest of the rest
    for i in range(n):
        own = kept[i][kept[i] >= 0]
        rest = both[i][(both[i] >= 0) & ~np.isin(both[i], own)]
        all_ = np.concatenate([own, rest])[:most]
        full[i, : len(all_)] = all_
    return full


def choose(x: np.ndarray, own: np.ndarray, near: np.ndarray, most: int, fill: bool) -> np.ndarray:
    """For vectors ``own``, of each row's candidates (numbers in x, -1: none) the diverse ones, nearest first; fill: room that is left goes to the nearest of the rest."""
    out = np.full((len(near), most), -1, np.int32)
    for at in range(0, len(near), 256):
        c = near[at : at + 256]
        there = x[np.maximum(c, 0)]
        d = np.where(c >= 0, 1 - np.einsum("rkd,rd->rk", there, own[at : at + 256]), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        c, d, there = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(there, order[:, :, None], 1)
        apart = 1 - there @ there.transpose(0, 2, 1)
        kept = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            closest = np.where(kept[:, :j], apart[:, j, :j], np.inf).min(axis=1, initial=np.inf)
            kept[:, j] = (c[:, j] >= 0) & (kept[:, :j].sum(axis=1) < most) & (d[:, j] < closest)
        rank = np.argsort(np.where(kept, d, d + 8 if fill else np.inf), axis=1, kind="stable")[:, :most]
        best = np.take_along_axis(np.where(kept | fill, c, -1), rank, 1)
        out[at : at + 256, : best.shape[1]] = best
    return out


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams of ef of the nodes x for all queries at once, nearest first, and their distances; entry holds numbers of nodes, each once a row, -1 for none."""
    n, m = len(q), len(x)
    row = np.arange(n)[:, None]
    seen = np.zeros((n, m + 1), bool)
    seen[row, entry] = True
    seen[:, m] = True
    beam = np.full((n, ef), -1, np.int32)
    dist = np.full((n, ef), np.inf, np.float32)
    width = min(ef, entry.shape[1])
    d = np.where(entry >= 0, 1 - np.einsum("qkd,qd->qk", x[np.maximum(entry, 0)], q), np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :width]
    beam[:, :width], dist[:, :width] = np.take_along_axis(entry, order, 1), np.take_along_axis(d, order, 1)
    done = beam < 0
    while True:
        open_ = np.where(done, np.inf, dist)
        nxt = open_.argmin(axis=1)
        live = np.flatnonzero(np.isfinite(open_[np.arange(n), nxt]))
        if not len(live):
            return beam, dist
        done[live, nxt[live]] = True
        new = links[beam[live, nxt[live]]]
        new = np.where((new < 0) | (new >= m), m, new)
        fresh = ~seen[live[:, None], new]
        seen[live[:, None], new] = True
        d = np.where(fresh, 1 - np.einsum("qkd,qd->qk", x[np.minimum(new, m - 1)], q[live]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_b = np.concatenate([beam[live], np.where(fresh, new, -1).astype(np.int32)], axis=1)
        all_f = np.concatenate([done[live], ~fresh], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        dist[live] = np.take_along_axis(all_d, order, 1)
        beam[live] = np.take_along_axis(all_b, order, 1)
        done[live] = np.take_along_axis(all_f, order, 1)


def descend(unit: np.ndarray, layers: list[np.ndarray], q: np.ndarray, below: int, ef: int = 16) -> np.ndarray:
    """Entries to the layer below all of ``layers`` (the lowest first), of its first ``below`` nodes."""
    entry = np.zeros((len(q), 1), np.int32)
    for links in layers[::-1]:
        entry, _ = walk(unit[: len(links)], links, q, entry, min(ef, len(links)))
    entry = np.where(entry < below, entry, -1)
    entry[(entry < 0).all(axis=1), 0] = 0
    return entry


def grow(unit: np.ndarray, n: int, above: list[np.ndarray], most: int, seed: int) -> np.ndarray:
    """Neighbour array of a layer of the first n nodes: the first ``seed`` from their distances, the others inserted in batches."""
    first = min(n, seed)
    links = np.full((n, most), -1, np.int32)
    links[:first] = _layer(unit[:first], most)
    for at in range(first, n, BATCH):
        end = min(n, at + BATCH)
        q = unit[at:end]
        found = np.concatenate([walk(unit[:at], links[:at], q[i : i + some], descend(unit, above, q[i : i + some], at), CANDIDATES)[0] for some in [max(16, MARKS // at)] for i in range(0, len(q), some)])
        far = np.where(np.tri(len(q), k=-1, dtype=bool), 1 - q @ q.T, np.inf)  # those before it in the batch
        near = np.argsort(far, axis=1)[:, :LINKS].astype(np.int32)
        near = np.where(np.isfinite(np.take_along_axis(far, near, 1)), near + at, -1)
        links[at:end, : min(most, LINKS)] = choose(unit, q, np.concatenate([found, near], axis=1), min(most, LINKS), False)
        heads, tails = links[at:end].ravel(), np.repeat(np.arange(at, end, dtype=np.int32), most)
        heads, tails = heads[heads >= 0], tails[heads >= 0]
        d = 1 - np.einsum("kd,kd->k", unit[heads], unit[tails])
        order = np.lexsort((d, heads))
        heads, tails = heads[order], tails[order]
        node, begin = np.unique(heads, return_index=True)
        place = np.arange(len(heads)) - np.repeat(begin, np.diff(np.append(begin, len(heads))))
        kept = place < most  # the nearest of what links to it now
        fresh = np.full((len(node), most), -1, np.int32)
        fresh[np.searchsorted(node, heads[kept]), place[kept]] = tails[kept]
        links[node] = choose(unit, unit[node], np.concatenate([links[node], fresh], axis=1), most, True)
    return links


def build(dim: int, shard: int, width: int, vectors: np.ndarray, ids: np.ndarray, seed: int = SEED) -> tuple:
    """One row of the index: layer 0 over all nodes, each layer above over the first in LINKS of the one below."""
    unit = (vectors / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
    sizes = [len(unit)]
    while sizes[-1] > 2 * LINKS and len(sizes) < TOP:
        sizes.append(-(-sizes[-1] // LINKS))
    layers: list[np.ndarray] = []
    for k in range(len(sizes) - 1, -1, -1):  # from the top
        layers.insert(0, grow(unit, sizes[k], layers, LINKS_0 if k == 0 else LINKS, seed))
    return dim, shard, len(unit), width, vectors.astype(f"<f{width}").tobytes(), ids.astype("<i8").tobytes(), np.array(sizes, "<i4").tobytes(), b"".join(x.astype("<i4").tobytes() for x in layers)


class Graph:
    def __init__(self, row: dict, most: int):
        self.vectors = np.frombuffer(row["vectors"], f"<f{row['width']}").reshape(row["n"], row["dim"])
        self.ids = np.frombuffer(row["ids"], "<i8").reshape(row["n"], most)
        self.norm = np.linalg.norm(self.vectors.astype(np.float64), axis=1)
        self.unit = (self.vectors / self.norm[:, None]).astype(np.float32)
        flat, at, self.layers = np.frombuffer(row["neighbours"], "<i4"), 0, []
        for k, n in enumerate(np.frombuffer(row["sizes"], "<i4")):
            wide = LINKS_0 if k == 0 else LINKS
            self.layers.append(flat[at : at + n * wide].reshape(n, wide))
            at += n * wide

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Numbers of the nearest nodes, nearest first, -1 for none."""
        n = len(self.unit)
        ef = min(n, max(ef, int(1.5 * n**0.5)))
        some = max(16, MARKS // n)
        return np.concatenate([walk(self.unit, self.layers[0], q[i : i + some], descend(self.unit, self.layers[1:], q[i : i + some], n), ef)[0] for i in range(0, len(q), some)])


def answer(graph: Graph, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int) -> pd.DataFrame:
    """The shard's k best of each query: cosines in double precision, ties to smaller ids, the query's own row left out."""
    wide = queries.astype(np.float64)
    norm = np.linalg.norm(wide, axis=1)
    found = graph.search((wide / norm[:, None]).astype(np.float32), ef)[:, : 4 * (k + 1)]
    at = np.maximum(found, 0)
    dots = np.einsum("qkd,qd->qk", graph.vectors[at].astype(np.float64), wide)
    score = np.where(found >= 0, dots / (graph.norm[at] * norm[:, None]), -np.inf)
    ids = graph.ids[at]
    row, col, each = np.nonzero((ids >= 0) & (found >= 0)[:, :, None] & (ids != query_ids[:, None, None]))
    d = pd.DataFrame({"query_id": query_ids[row], "vec_id": ids[row, col, each], "score": score[row, col]}).drop_duplicates(["query_id", "vec_id"])
    return d.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def index(rows: DataFrame, *, k: int = 5, shard_rows: int = 1 << 16, shard_bytes: int = 1 << 28, seed: int = SEED, spread: int = SPREAD) -> DataFrame:
    """The graphs of all usable vectors, a row a shard: of about ``shard_rows`` vectors and ``shard_bytes`` of them at most."""
    most, width = k + 1, number_width(rows)
    d = cut(distinct_vectors(usable(rows), most).withColumn("dim", (F.octet_length("vector") / width).cast("int")), "vectors")
    n = F.count(F.lit(1))
    dims = d.groupBy("dim").agg(F.greatest(F.ceil(n / shard_rows), F.ceil(n * F.col("dim") * F.lit(width) / shard_bytes), F.least(F.lit(spread), F.ceil(n / seed))).cast("int").alias("shards"))
    dims = cut(dims, "shards")
    tasks = _tasks(dims.agg(F.sum("shards")).first()[0])
    d = d.join(dims, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))

    def graph(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(_h=pd.util.hash_array(part["vector"].map(hash_bytes).to_numpy())).sort_values(["_h", "vector"])
        dim, n = int(part["dim"].iloc[0]), len(part)
        vectors = np.frombuffer(b"".join(part["vector"]), f"<f{width}").reshape(n, dim)
        ids = np.full((n, most), -1, np.int64)
        for i, own in enumerate(part["ids"]):
            ids[i, : len(own)] = own
        return pd.DataFrame([build(dim, int(part["shard"].iloc[0]), width, vectors, ids, seed)], columns=[c.split()[0] for c in INDEX.split(", ")])

    return d.select("dim", "shard", "vector", "ids").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(graph, INDEX)


def _tasks(groups: int | None) -> int:
    """Partitions for groups that are small but take long, so that few share one; Spark would put them together by their bytes."""
    return min(2 * (groups or 1), 20_000)


def hash_bytes(v: bytes) -> int:
    import zlib

    return zlib.crc32(v)


def search(graphs: DataFrame, queries: DataFrame, *, k: int = 5, ef: int = 96, block_rows: int = 1024, blocks_a_task: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each usable query."""
    q = usable(queries).dropDuplicates().withColumn("dim", F.size("embedding"))
    q = cut(q, "queries")
    blocks, kind = max(1, math.ceil(q.count() / block_rows)), f"<f{number_width(queries)}"
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", (F.col("block") / blocks_a_task).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(part["embedding"].to_list()).astype(kind).tobytes()
        return part.iloc[:1][["dim", "block", "part"]].assign(ids=[part["vec_id"].to_numpy().astype("<i8").tobytes()], vectors=[data])

    packed = q.groupBy("dim", "block", "part").applyInPandas(pack, "dim int, block int, part int, ids binary, vectors binary")
    shards = graphs.groupBy("dim").agg(F.max("shard").alias("last"))
    packed = packed.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last"))))
    parts = (blocks - 1) // blocks_a_task + 1
    spread = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if len(left):
            graph = Graph(left.iloc[0].to_dict(), k + 1)
            for ids, vectors in zip(right["ids"], right["vectors"]):
                own = np.frombuffer(ids, "<i8")
                out.append(answer(graph, own, np.frombuffer(vectors, kind).reshape(len(own), -1), k, ef))
        return pd.concat(out) if len(out) > 1 else out[0]

    keys = ["dim", "shard", "part"]
    tasks = _tasks(graphs.select("dim", "shard").count() * parts)
    met = spread.repartition(tasks, *keys).groupBy(*keys).cogroup(packed.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(meet, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = 5, ef: int = 96, **options) -> DataFrame:
    return search(cut(index(rows, k=k, **options), "graphs"), queries, k=k, ef=ef)

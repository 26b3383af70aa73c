"""Operator 12: Merkle manifest of a dataset, with a proof for every row.

A leaf is the SHA-256 of a row's fields, each with its length before it. Leaves of a group (the source) stand in order; every
``FAN`` consecutive nodes become the hash of their hex digests until one is left, the group's root, and the groups' roots become the
dataset's in the same way.

Aligned blocks of ``FAN ** height`` nodes are walked in tasks of their own: a recursion in postorder returns a
subtree's digest, and while it unwinds the siblings of each child are appended to the proofs of the leaves that the child contains. Block roots are
the nodes of the next round, so rounds grow with the logarithm of a group's size. On the way down each block is walked
again with the siblings above its root, which are worked out in the same way for the block roots; so proofs, far longer than the leaves, are never stored or moved.

Places come from a table sorted in ranges of (group, order) and written once: a row's number in its file plus the rows of the group in the
files before. Neither a group nor the whole table is one task or one window.

Cases: a null field is told from an empty one; null and empty texts, very long texts (hashed whole in the JVM) and other values alike are
leaves; rows without the order's key come first in their group; rows that tie there are in the order of their leaves, and rows that repeat are
equal leaves side by side; a group of one row has its leaf as root; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, located

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The siblings left and right of the node that leads to a leaf, level by level; digests follow each other in 32 bytes each.
PATH = "array<struct<left:binary,right:binary>>"
ANSWER = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field's bytes after their number and a colon, a null as '-'."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(one(c.cast("string")) for c in fields)), 256))


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digest(nodes: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def height_of(n: int) -> int:
    """Levels above n nodes until one is left."""
    height = 0
    while FAN**height < n:
        height += 1
    return height


def walk(nodes: list[bytes], lo: int, hi: int, height: int, proofs: list[list[tuple[bytes, bytes]]] | None) -> bytes:
    """Digest of the subtree over nodes lo to hi; its leaves' ``proofs`` get the siblings of each level, from below."""
    if not height:
        return nodes[lo]
    step = FAN ** (height - 1)
    begins = range(lo, hi, step)
    children = [walk(nodes, at, min(at + step, hi), height - 1, proofs) for at in begins]
    if proofs is not None:
        for i, at in enumerate(begins):
            beside = (b"".join(children[:i]), b"".join(children[i + 1 :]))
            for own in range(at, min(at + step, hi)):
                proofs[own].append(beside)
    return digest(children)


def fold(own: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        own = digest((left, own, right))
    return own


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with ``key``) with pos, their number in the key's order from 0, and m, the key's rows."""
    spread = located(rows).withColumn("_tie", F.xxhash64("_at_file", "_at_row")).drop("_at_file", "_at_row")  # splits rows that repeat, too
    by = ["key", *order, "_tie"]
    at = located(cut(spread.repartitionByRange(*by).sortWithinPartitions(*by), "merkle-order"))
    runs = at.groupBy("key", "_at_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_at_row").alias("_first"), F.min(F.struct(*by[1:])).alias("_least"))
    own = Window.partitionBy("key")  # a row a file
    before = own.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "_at_file", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("m"))
    return at.join(runs, ["key", "_at_file"]).withColumn("pos", F.col("_at_row") + F.col("_shift")).drop("_at_file", "_at_row", "_shift", "_tie")


def _read(nodes: pa.Table, height: int) -> tuple[pa.Table, list[bytes], int]:
    """A block's rows in order, their digests, and the levels to its root."""
    nodes = nodes.sort_by("pos")
    m = nodes.column("m")[0].as_py()
    return nodes, nodes.column("digest").to_pylist(), height if m > FAN**height else height_of(m)


def climb(nodes: DataFrame, most: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, and the root (key, digest) of each key; ``most`` is the largest key's number of nodes."""
    width, rounds = FAN**height, []

    def root(table: pa.Table) -> pa.Table:
        own, digests, up = _read(table, height)
        return pa.table({"key": [own.column("key")[0].as_py()], "m": [own.column("m")[0].as_py()], "block": [own.column("block")[0].as_py()], "digest": [walk(digests, 0, len(digests), up, None)]})

    while True:
        nodes = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(width)))
        rounds.append(nodes)
        roots = cut(nodes.select("key", "m", "pos", "block", "digest").groupBy("key", "block").applyInArrow(root, "key string, m long, block long, digest binary"), "merkle-roots")
        if most <= width:
            return rounds, roots.select("key", "digest")
        most = -(-most // width)
        nodes = roots.select("key", F.ceil(F.col("m") / F.lit(width)).alias("m"), F.col("block").alias("pos"), "digest")


def _down(nodes: DataFrame, above: DataFrame, height: int, schema: str, emit) -> DataFrame:
    """``emit(rows in order, digests, proofs, the row above)`` of every block of ``nodes`` with its row of ``above`` (key, block, path, ...)."""
    kinds = [(f.split(" ", 1)[0]) for f in schema.split(", ")]

    def unwind(table: pa.Table, over: pa.Table) -> pa.Table:
        own, digests, up = _read(table, height)
        (top,) = over.to_pylist()
        proofs: list[list[tuple[bytes, bytes]]] = [[] for _ in digests]
        walk(digests, 0, len(digests), up, proofs)
        path = [(x["left"], x["right"]) for x in top["path"]]
        for p in proofs:
            p.extend(path)
        return pa.table(dict(zip(kinds, emit(own, digests, proofs, top))))

    return nodes.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInArrow(unwind, schema)


def _path(p: list[tuple[bytes, bytes]]) -> list[dict[str, bytes]]:
    return [{"left": a, "right": b} for a, b in p]


def descend(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The rows above (key, block, path, subroot) each block of the first round, from those above each key's last block."""
    kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))

    def emit(own, digests, proofs, top):
        return own.column("key"), own.column("pos"), pa.array(map(_path, proofs), kind), pa.array([top["subroot"]] * len(digests), pa.binary())

    for nodes in reversed(rounds[1:]):
        above = cut(_down(nodes, above, height, f"key string, block long, path {PATH}, subroot binary", emit), "merkle-paths")
    return above


def manifest(docs: DataFrame, *, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", text: str = "text", height: int = 2) -> DataFrame:
    """doc_id (the order's key), leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    The proof is checked with a leaf whose text is tampered with where ``tampered`` says so.
    """
    low = [F.translate(text, UPPER, LOWER) if f == text else F.col(f) for f in fields]
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-"))  # null first, then by bytes
    rows = docs.select(key.alias("key"), F.col(order).alias("doc_id"), leaf([F.col(f) for f in fields]).alias("digest"), F.when(tampered(F.col(order)), leaf(low)).alias("altered"))
    rows = cut(numbered(cut(rows, "merkle-leaves"), ["doc_id", "digest"]), "merkle-places")
    most = rows.agg(F.max("m")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], ANSWER)
    rounds, subroots = climb(rows, most, height)

    named = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), ["name"])
    named = cut(named, "merkle-groups")
    over, top = climb(named, named.agg(F.max("m")).first()[0], height)
    root = bytes(top.first().digest)  # the only row
    begin = docs.sparkSession.createDataFrame([("", 0, [], None)], f"key string, block long, path {PATH}, subroot binary")
    kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))

    def of_group(own, digests, proofs, above):
        return own.column("name"), pa.array([0] * len(digests), pa.int64()), pa.array(map(_path, proofs), kind), pa.array(digests, pa.binary())

    def of_leaf(own, digests, proofs, above):
        hexed = lambda xs: pa.array([x.hex() for x in xs], pa.string())
        altered = own.column("altered").to_pylist()
        folded = [fold(d if a is None else a, p) for d, a, p in zip(digests, altered, proofs)]
        joined = [hashlib.sha256(b"".join(x for pair in p for x in pair).hex().encode()).digest() for p in proofs]
        same = lambda x: hexed([x] * len(digests))
        return own.column("doc_id"), hexed(digests), same(above["subroot"]), same(root), hexed(joined), hexed(folded), pa.array([f == root for f in folded])

    groups = descend(over, begin, height)
    paths = cut(_down(over[0], groups, height, f"key string, block long, path {PATH}, subroot binary", of_group), "merkle-paths")
    return _down(rounds[0], descend(rounds, paths, height), height, ANSWER, of_leaf)


def manifest_sql(levels: int = 6) -> str:
    """DuckDB's form of the query, for at most FAN ** levels rows a source and as many sources."""
    field = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR))::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    out = [
        f"""d AS (SELECT doc_id, coalesce('=' || source, '-') AS g, {row("text")} AS leaf, {row(f"translate(text, '{UPPER}', '{LOWER}')")} AS low,
  list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents)""",
        "s0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d)",
    ]

    def tree(t: str) -> None:
        """Levels of the trees: nodes (g, i, h), in the end one each; of one left alone nothing is hashed."""
        for k in range(levels):
            out.append(f"{t}n{k} AS (SELECT g, i // {FAN} AS i, list(h ORDER BY i) AS kids, max(n) > 1 AS joined FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {t}{k}) GROUP BY g, i // {FAN})")
            out.append(f"{t}{k + 1} AS (SELECT g, i, CASE WHEN joined THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS h FROM {t}n{k})")

    tree("s")
    out.append(f"t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM s{levels})")
    tree("t")
    out.append(f"names AS (SELECT g AS name, row_number() OVER (ORDER BY g) - 1 AS ti, h AS subroot FROM s{levels})")
    out.append(f"p0 AS (SELECT *, CASE WHEN (xor(crc, 4294967295) % 5) = 0 THEN low ELSE leaf END AS f, '' AS p, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)")
    cur = "p0"
    for t in "st":
        if t == "t":
            out.append(f"q0 AS (SELECT x.* EXCLUDE (i, g), ti AS i, '' AS g, subroot FROM {cur} x JOIN names ON name = x.g)")
            cur = "q0"
        for k in range(levels):
            left, right = f"array_to_string(kids[:(x.i % {FAN})], '')", f"array_to_string(kids[(x.i % {FAN} + 2):], '')"
            nxt = f"{t}p{k + 1}"
            out.append(f"{nxt} AS (SELECT x.* EXCLUDE (i, f, p), x.i // {FAN} AS i, CASE WHEN joined THEN sha256({left} || f || {right}) ELSE f END AS f, CASE WHEN joined THEN p || {left} || {right} ELSE p END AS p FROM {cur} x JOIN {t}n{k} n ON n.g = x.g AND n.i = x.i // {FAN})")
            cur = nxt
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM {cur}, t{levels} r"

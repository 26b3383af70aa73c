"""Operator 11: fill-in-middle transformation of whole texts, cut between units.

Each text becomes a UTF-32 array of code points. A kind of unit gives every code point a class and says between
which neighbouring classes a unit ends; ``flatnonzero`` of that comparison yields the boundaries, two of them are
chosen by rank, and the pieces between are sliced and encoded again. The default unit is a line with its line feed.

Draws come from the SHA-256 of ``seed:doc_id``, so reruns and lost tasks give the same rows: its first four groups
of eight hex digits choose the two cuts, whether the text is transformed, and in which order. The order ``psm`` writes prefix,
suffix, middle, ``spm`` suffix, prefix, middle, each after its marker; ``plain`` is the text as it was. Markers must not be able to
overlap, so that ``restore`` can tell them apart wherever the text is cut. Every row is worked out on its own, nothing is shuffled.

Cases: null and empty texts are plain, of 0 units and with an empty output; texts that hold a marker are plain; very long texts are
read whole, in a task's memory at four bytes a code point; equal cuts give an empty middle; rows that repeat give equal rows; a row without doc_id draws by an empty number;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: what stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Units:
    """Units of text: the code points of each class but the first, and the pairs of neighbouring classes between which a unit ends."""

    classes: tuple[str, ...]
    ends: frozenset[tuple[int, int]]

    def boundaries(self, points: np.ndarray) -> np.ndarray:
        """Where units begin but for the first, in order."""
        kinds = np.zeros(len(points), np.int8)
        for k, members in enumerate(self.classes, 1):
            kinds[np.isin(points, np.frombuffer(members.encode("utf-32-le"), "<u4"))] = k
        size = len(self.classes) + 1
        parts = np.zeros((size, size), bool)
        for before, after in self.ends:
            parts[before, after] = True
        return np.flatnonzero(parts[kinds[:-1], kinds[1:]]) + 1


#: Lines end after their line feed, words with the white space after them before the next one begins.
LINES = Units(("\n",), frozenset({(1, 0), (1, 1)}))
WORDS = Units((" \t\n\v\f\r",), frozenset({(1, 0)}))


def check_markers(markers: tuple[str, ...]) -> None:
    """Markers that differ, and of which none holds or overlaps another or itself: no false one arises where pieces meet."""
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            overlap = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))
            if not a or overlap or i != j and a in b:
                raise ValueError(f"markers {a!r} and {b!r} overlap")


def draws(seed: int, doc_id: int | None) -> list[int]:
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]


def transform_one(doc_id: int | None, text: str | None, *, units: Units = LINES, seed: int = 7, share: int = 100, spm: int = 50, markers: tuple[str, ...] = MARKERS) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    if not text:
        return 0, "plain", None, None, ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    begins = units.boundaries(points)
    n = len(begins) + 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if h3 % 100 >= share or any(m in text for m in markers):
        return n, "plain", None, None, text
    edges = np.concatenate([[0], begins, [len(points)]])
    lo, hi = sorted((int(edges[h1 % (n + 1)]), int(edges[h2 % (n + 1)])))
    prefix, middle, suffix = (points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in ((0, lo), (lo, hi), (hi, len(points))))
    p, s, m = markers
    if h4 % 100 < spm:
        return n, "spm", lo, hi - lo, s + suffix + p + prefix + m + middle
    return n, "psm", lo, hi - lo, p + prefix + s + suffix + m + middle


def transform(docs: DataFrame, *, units: Units = LINES, seed: int = 7, share: int = 100, spm: int = 50, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (the text to train on) of every row of ``docs``.

    ``share`` of 100 texts are transformed, ``spm`` of 100 of those with the suffix first.
    """
    check_markers(markers)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # answers of long texts do not pile up
                ids, texts = (b.column(k).slice(at, 256) for k in (0, 1))
                rows = [transform_one(i.as_py(), t.as_py(), units=units, seed=seed, share=share, spm=spm, markers=markers) for i, t in zip(ids, texts)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, SCHEMA)


def restore(output: Column, form: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """The exact text, from output and form alone."""
    check_markers(markers)
    either = "|".join(f"\\Q{m}\\E" for m in markers)
    pieces = F.array(F.split(output, either, -1))
    joined = lambda *order: F.get(F.transform(pieces, lambda p: F.concat(*(F.get(p, F.lit(i)) for i in order))), F.lit(0))
    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)


def transform_sql() -> str:
    """DuckDB's form of the query."""
    p, s, m = MARKERS
    h = lambda k: f"('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::BIGINT"
    piece = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, {h(0)} AS h1, {h(1)} AS h2, {h(2)} AS h3, {h(3)} AS h4 FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (SELECT *, {piece('1', 'a')} AS p, {piece('a + 1', 'b')} AS m, {piece('b + 1', 'n')} AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || p || '{s}' || s || '{m}' || m ELSE '{s}' || s || '{p}' || p || '{m}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""

"""The matching characters of two texts as difflib counts them, by whole-matrix steps on one long integer."""

from __future__ import annotations

from difflib import SequenceMatcher

#: From so many characters of the second text on, difflib leaves out its frequent ones.
AUTOJUNK = 200


def matched(a: str, b: str) -> int:
    """Characters in difflib's matching blocks, where it leaves out none (``b`` has fewer than ``AUTOJUNK``).

    Bit i * width + j of the matrix tells whether a[i] is b[j]; a run of equal characters is a diagonal, so one shift and one "and" of the whole
    matrix lengthen all runs by a character. Of the longest runs the lowest bit is the one that difflib takes: first in ``a``, then in ``b``. What
    crosses it is cleared, and no run can cross a cleared row, so all that difflib does to the left and to the right of a block stays in the same matrix.
    """
    size = len(b) // 8 + 1  # a free column at least, so no run goes on in the next row
    width, bits = 8 * size, {}
    for j, c in enumerate(b):
        bits[c] = bits.get(c, 0) | 1 << j
    rows, none = {c: v.to_bytes(size, "little") for c, v in bits.items()}, bytes(size)
    cells = int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")
    total = 0
    while cells:
        length, longest = 1, cells
        while more := (longest << (width + 1)) & cells:
            length, longest = length + 1, more
        i, j = divmod((longest & -longest).bit_length() - 1, width)
        total += length
        before, after = (1 << (j - length + 1)) - 1, (1 << len(b)) - (2 << j)
        first, rest = i - length + 1, cells >> ((i + 1) * width)
        cells &= int.from_bytes(before.to_bytes(size, "little") * first, "little") if before and first else 0
        if rest and after:
            cells |= (rest & int.from_bytes(after.to_bytes(size, "little") * (len(a) - i - 1), "little")) << ((i + 1) * width)
    return total


def ratio(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b).ratio()``."""
    if a == b:
        return 1.0
    if len(b) >= AUTOJUNK:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * matched(a, b) / (len(a) + len(b))

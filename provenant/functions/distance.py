"""Levenshtein distance of whole texts, by code points.

A column of the distance table is kept as two bit vectors, where it goes up and where it goes down by one from row to row, so that a column
costs a few operations on whole numbers. Only a band of ``k`` rows to either side of the diagonal is kept; it moves down one row with
each column. It holds every alignment of at most ``k`` edits, so a result up to ``k`` is the distance; else the band doubles.

Before that, similar texts are tried by waves: how far ``d`` edits reach on each diagonal, for d = 0, 1 and so on, equal stretches being
passed in slices. That costs the square of the distance instead of the length, and is given up where the columns would cost less.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Edits the first band holds.
FIRST_BAND = 64
#: Cost of a column over that of a diagonal of a wave.
WAVE_SHARE = 6


def _within(a: str, b: str, k: int) -> int | None:
    """The distance if it is at most ``k``; ``b`` is no longer than ``a``, and by at most ``k`` shorter."""
    m, n = len(a), len(b)
    mask, diagonal = (1 << 2 * k + 1) - 1, 1 << k
    places: dict[str, int] = {}
    for row, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << row + k
    # Bit i stands for row j - k + i of column j. Before the first column the rows count up from row 0.
    up, down, value = mask ^ (diagonal - 1), 0, 0
    for j, letter in enumerate(b):
        same = places.get(letter, 0) >> j & mask
        free = (((same & up) + up) ^ up) | same | down
        right_up, right_down = (down | ~(free | up)) & mask, free & up
        if not free & diagonal:
            value += 1
            # Values do not fall along the diagonal, and by one a row at most below it.
            if value > k + m - n:
                return None
        free = (free & mask) >> 1
        up, down = (right_down | ~(free | right_up)) & mask, free & right_up
    for i in range(k, k + m - n):
        value += (up >> i & 1) - (down >> i & 1)
    return value if value <= k else None


def _alike(a: str, b: str, i: int, j: int) -> int:
    """How many letters from ``a[i]`` and ``b[j]`` on are equal."""
    begin, size = i, 32
    while a[i:i + size] == b[j:j + size]:
        if i + size >= len(a) or j + size >= len(b):
            # A shorter slice is equal only to one as short, so both texts may end here, or a whole slice ends one.
            return min(len(a) - i, len(b) - j, size) + i - begin
        i, j = i + size, j + size
    while size > 1:
        size //= 2
        if a[i:i + size] == b[j:j + size]:
            i, j = i + size, j + size
    return i - begin


def _waves(a: str, b: str, most: int) -> int | None:
    """The distance if it is at most ``most``; ``b`` is not empty and no longer than ``a``."""
    m, n = len(a), len(b)
    last = m - n
    if last > most:
        return None
    # Diagonal k holds the pairs of places (i, i - k); reach[k + most + 1] is the furthest i of a wave, ends being letters of which none is equal.
    shift, none = most + 1, -most - 3
    reach = [none] * (2 * most + 3)
    reach[shift] = _alike(a, b, 0, 0)
    if not last and reach[shift] == m:
        return 0
    ends_a, ends_b = a + "\0", b + "\1"
    for d in range(1, most + 1):
        # Beyond these diagonals the last one is not reached with the edits left, or not yet.
        low, high = max(-d, last - (most - d)), min(d, last + most - d)
        moved = [none] * len(reach)
        for k in range(low, high + 1):
            at = k + shift
            i, left, right = reach[at] + 1, reach[at - 1] + 1, reach[at + 1]
            if left > i:
                i = left
            if right > i:
                i = right
            j = i - k
            if i < 0 or j < 0:
                continue
            if i > m or j > n:
                i = min(m, n + k)
                j = i - k
            if ends_a[i] == ends_b[j]:
                i += _alike(a, b, i, j)
            moved[at] = i
        reach = moved
        if reach[last + shift] >= m:
            return d
    return None


def distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements of single code points that turn one text into the other."""
    if len(a) < len(b):
        a, b = b, a
    start, shorter = 0, len(b)
    while start < shorter and a[start] == b[start]:
        start += 1
    end = 0
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:shorter - end]
    if not b:
        return len(a)
    # Waves up to this many edits take about as long as one pass over the columns.
    most = int((WAVE_SHARE * len(b)) ** 0.5)
    if (found := _waves(a, b, most)) is not None:
        return found
    k = max(FIRST_BAND, len(a) - len(b), 2 * most)
    while (found := _within(a, b, min(k, len(a)))) is None:
        k *= 2
    return found


@F.pandas_udf(LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distance of two columns of texts; null if either is null."""
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int64")

"""Edit distances of long texts by bit vectors (SEG2, SEG4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs with at least so many cells (product of the lengths) go by bit vectors; shorter ones by the built-in function.
LONG_CELLS = 250_000


def bit_distance(a: str, b: str, at_most: int | None = None) -> int:
    """The edit distance of two texts, -1 if above ``at_most``.

    Column by column of the alignment table, whose differences from one row to the next (-1, 0, 1) are two bit vectors
    over the longer text, each one whole number of any length (Myers 1999, Hyyro 2003): a column, one character of the
    shorter text, takes a dozen operations on vectors, so the fewest operations, each on the longest vector. It stops
    once the columns that are left cannot bring the distance down to ``at_most``."""
    if len(a) < len(b):
        a, b = b, a
    if at_most is not None and len(a) - len(b) > at_most:
        return -1
    start, end = 0, 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m = len(a)
    if not b:
        return m if at_most is None or m <= at_most else -1
    letters = np.frombuffer(a.encode("utf-32-le"), "<u4")
    equal = {c: int.from_bytes(np.packbits(letters == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    ones, top = (1 << m) - 1, m - 1
    up, down, distance = ones, 0, m
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        eq = equal[c]
        across = (((eq & up) + up) ^ up) | eq
        more = down | (ones & ~(across | up))
        less = up & across
        if more >> top:
            distance += 1
            if at_most is not None and distance - left > at_most:
                return -1
        elif less >> top:
            distance -= 1
        more = (more << 1) | 1
        either = eq | down
        up = (less << 1) | ~(either | more)
        up, down = up & ones, more & either & ones
    return distance if at_most is None or distance <= at_most else -1


def edit_distance(a: Column, b: Column, at_most: int | None = None) -> Column:
    """The edit distance of two texts in code points; -1 above ``at_most``, null where either is null. The built-in function
    fills a table of both lengths; long pairs go by bit vectors over Arrow batches instead."""
    both = a.isNotNull() & b.isNotNull()
    long = both & (F.length(a).cast("long") * F.length(b) >= LONG_CELLS)

    @F.pandas_udf("int")
    def by_bits(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else bit_distance(p, q, at_most) for p, q in zip(x, y)], dtype="Int32")

    # what does not go by this way is null there, so each pair is measured once
    short = F.levenshtein(F.when(~long, a), F.when(~long, b), at_most) if at_most is not None else F.levenshtein(F.when(~long, a), F.when(~long, b))
    return F.coalesce(by_bits(F.when(long, a), F.when(long, b)), short)

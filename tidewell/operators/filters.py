"""Filters and row-wise projections (PRJ3, PRJ6-13, PRJ15-17, SET1-3, SET5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import dense_index

COUNTS = ("matches", "mismatches", "insertions", "deletions")


def divergence(counts: Sequence[str] = COUNTS) -> Column:
    """(mismatch + insertion + deletion) / all, nulls as 0; null where nothing was counted (PRJ3)."""
    m, *rest = (F.coalesce(F.col(c), F.lit(0)) for c in counts)
    off = reduce(lambda a, b: a + b, rest)
    return F.try_divide(off, m + off)


def max_divergence(segments: DataFrame, key: str = "name", only: Sequence[str] | None = None) -> DataFrame:
    """The largest divergence over a read's segments."""
    rows = segments.filter(F.col("segment").isin(*only)) if only else segments
    return rows.groupBy(key).agg(F.max(divergence()).alias("max_divergence"))


def perfect_reads(segments: DataFrame, key: str = "name") -> DataFrame:
    """Reads all of whose segments have divergence 0 (PRJ11)."""
    return segments.groupBy(key).agg(F.max(divergence()).alias("_d")).filter("_d = 0").select(key)


def mean_phred(phred: str = "read_phred") -> Column:
    return F.aggregate(phred, F.lit(0.0), lambda a, x: a + x, lambda a: F.try_divide(a, F.size(phred)))


def default_quality(df: DataFrame, quality: str = "qs", phred: str = "read_phred") -> DataFrame:
    """Quality as the mean Phred score where it is missing (PRJ6); the column is made if there is none."""
    mean = mean_phred(phred)
    return df.withColumn(quality, F.coalesce(F.col(quality), mean) if quality in df.columns else mean)


def in_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows strictly inside every range (PRJ7)."""
    return df.filter(reduce(and_, [(F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in ranges.items()], F.lit(True)))


def shift_and_clip(df: DataFrame, dx: float, dy: float, limits: tuple[float, float, float, float]) -> DataFrame:
    """Every *_x and *_y moved, boxes with all corners within (x0, x1, y0, y1) kept, ends included (PRJ8)."""
    x0, x1, y0, y1 = limits
    xs, ys = ([c for c in df.columns if c.endswith(s)] for s in ("_x", "_y"))
    moved = df.withColumns({c: F.col(c) + d for cs, d in ((xs, dx), (ys, dy)) for c in cs})
    inside = [F.col(c).between(lo, hi) for cs, lo, hi in ((xs, x0, x1), (ys, y0, y1)) for c in cs]
    return moved.filter(reduce(and_, inside, F.lit(True)))


def length_between(df: DataFrame, seq: str, low: int, high: int) -> DataFrame:
    return df.filter(F.length(seq).between(low, high))


def complete_families(df: DataFrame, relatives: Sequence[str], score: str, below: float) -> DataFrame:
    """Rows whose relatives are all known (not -1) and whose trench scores low enough (PRJ10)."""
    return df.filter(reduce(and_, [F.col(c) != -1 for c in relatives]) & (F.col(score) < below))


def no_nan(df: DataFrame, vectors: Sequence[str]) -> DataFrame:
    """Rows none of whose vectors holds a NaN (PRJ12)."""
    return df.filter(reduce(and_, [~F.exists(v, lambda x: F.isnan(x)) for v in vectors]))


def pivot_tags(df: DataFrame, key: str, tags: str, names: Sequence[str]) -> DataFrame:
    """array<struct<tag, value>> as a column per tag (PRJ13)."""
    each = df.select(key, F.explode(tags).alias("t")).select(key, "t.tag", "t.value")
    return each.groupBy(key).pivot("tag", list(names)).agg(F.first("value"))


def flat_field(pixels: DataFrame, calibration: DataFrame, value: str = "value") -> DataFrame:
    """(v - dark) / (flat - dark) by channel and pixel (PRJ15, STR3); null where flat equals dark."""
    out = pixels.join(calibration.select("channel", "y", "x", "dark", "flat"), ["channel", "y", "x"])
    return out.withColumn(value, F.try_divide(F.col(value) - F.col("dark"), F.col("flat") - F.col("dark"))).drop("dark", "flat")


def grid_index(df: DataFrame, group: Sequence[str], coords: Sequence[str], reverse: Sequence[str] = ()) -> DataFrame:
    """The rank of each distinct coordinate, from 0, backwards where asked (PRJ16)."""
    order = {c: F.desc(c) if c in set(reverse) else F.asc(c) for c in coords}
    return df.withColumns({f"{c}_index": (F.dense_rank().over(Window.partitionBy(*group).orderBy(order[c])) - 1).cast("long") for c in coords})


def tolerance_grid(df: DataFrame, group: Sequence[str], coord: str, delta: float, into: str) -> DataFrame:
    """Positions closer than ``delta`` to the one before share a number, counted from 0 (PRJ17)."""
    w = Window.partitionBy(*group).orderBy(coord)
    new = F.when(F.col(coord) - F.lag(coord).over(w) > delta, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(into, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def widened_union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that one lacks are null there (SET1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_keys(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Distinct keys that all frames have (SET2)."""
    return reduce(lambda a, b: a.intersect(b), [f.select(*key) for f in frames])


def missing_keys(attempted: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys attempted and not done (SET3)."""
    return attempted.select(*key).distinct().join(done.select(*key).distinct(), list(key), "left_anti")


def remove_bits(codebook: DataFrame, barcode: str, bits: Sequence[int], index: str = "barcodeid") -> DataFrame:
    """Barcodes without the given bits; those that then coincide all go, the rest are numbered anew (SET5)."""
    kept = F.array_join(F.filter(F.split(barcode, ""), lambda c, i: (c != "") & ~i.isin(*bits)), "")
    cut = codebook.withColumn(barcode, kept).drop(index)
    counts = cut.groupBy(barcode).agg(F.count(F.lit(1)).alias("_n"))
    lone = cut.join(counts.filter("_n = 1").select(barcode), barcode, "left_semi")
    return dense_index(lone, [barcode], index)

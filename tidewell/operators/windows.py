"""Windows over ordered groups (WIN2-20)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import sized_broadcast, written
from .numbering import dense_index, running


def elapsed(df: DataFrame, group: Sequence[str], time: str, into: str = "elapsed") -> DataFrame:
    """Time since the group's first (WIN2)."""
    return df.withColumn(into, F.col(time) - F.min(time).over(Window.partitionBy(*group)))


def step_rates(df: DataFrame, group: Sequence[str], order: Sequence[str], time: str, size: str) -> DataFrame:
    """Between a row and the one before: dt, mid_time, linear rate an hour and doubling time in hours (WIN3).

    The first row of a group has nulls; so have steps without time, and doubling times without growth.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    t0, s0 = F.lag(time).over(w), F.lag(size).over(w)
    out = df.withColumns({"_t0": t0, "_s0": s0})
    dt = F.col(time) - F.col("_t0")
    return out.withColumns({
        "dt": dt, "mid_time": (F.col(time) + F.col("_t0")) / 2,
        "linear_rate": F.try_divide((F.col(size) - F.col("_s0")) * 3600.0, dt),
        "doubling_time": F.try_divide(math.log(2) * dt / 3600.0, F.ln(F.when((F.col("_s0") > 0) & (F.col(size) > 0), F.col(size) / F.when(F.col("_s0") > 0, F.col("_s0"))))),
    }).drop("_t0", "_s0")


def relative_pixels(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], pixel_size: float) -> DataFrame:
    """Coordinates less the group's first, in whole pixels, cut toward zero (WIN4)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{c}_px": ((F.col(c) - F.first(c).over(w)) / pixel_size).cast("int") for c in columns})


def background_subtract(df: DataFrame, group: Sequence[str], is_background: Column, columns: Sequence[str]) -> DataFrame:
    """Values less the group's background row, which goes (WIN5)."""
    w = Window.partitionBy(*group)
    out = df.withColumn("_bg", is_background).withColumns({f"{c}_sub": F.col(c) - F.max(F.when(is_background, F.col(c))).over(w) for c in columns})
    return out.filter(~F.col("_bg")).drop("_bg")


def reindex_within(df: DataFrame, parent: Sequence[str], child: str, into: str) -> DataFrame:
    """Children renumbered from 0 within their parent, in order (WIN7); equal children share a number."""
    return df.withColumn(into, (F.dense_rank().over(Window.partitionBy(*parent).orderBy(child)) - 1).cast("long"))


def chunk_of(index: Column, n: int) -> tuple[Column, Column]:
    """Chunk and place in it of a dense index (WIN8)."""
    return F.floor(index / n).cast("long"), F.pmod(index, F.lit(n)).cast("long")


def median_filter_outliers(df: DataFrame, order: str, value: str, width: int = 5, n_sigma: float = 2.0, per_bucket: int = 100_000) -> DataFrame:
    """``normal``: within n_sigma deviations of the running median, mirrored at the ends (WIN9).

    Rows are numbered densely; the medians run in buckets of numbers, each with the rows around it.
    """
    half = width // 2
    rows = written(dense_index(df, [order], "_i", start=1), "numbered")
    n = rows.count()
    # row i repeated beyond the ends, reflected with the end itself: 0 -> 1, -1 -> 2, n+1 -> n, n+2 -> n-1
    at = F.array(F.col("_i"), F.when(F.col("_i") <= half, 1 - F.col("_i")), F.when(F.col("_i") > n - half, 2 * n + 1 - F.col("_i")))
    spread = rows.select(F.explode(F.array_compact(at)).alias("_at"), F.col(value).alias("_v"))
    bucket = lambda c: F.floor(c / per_bucket)
    near = F.array_distinct(F.array(bucket(F.col("_at") - half), bucket(F.col("_at")), bucket(F.col("_at") + half)))
    around = Window.partitionBy("_b").orderBy("_at").rowsBetween(-half, half)
    smooth = spread.select("_at", "_v", F.explode(near).alias("_b")).withColumn("_m", F.percentile("_v", 0.5).over(around))
    smooth = smooth.filter(F.col("_b") == bucket(F.col("_at"))).select(F.col("_at").alias("_i"), "_m")
    out = rows.join(smooth, "_i").withColumn("residual", F.col(value) - F.col("_m"))
    spread_of = out.agg(F.avg("residual").alias("_mean"), F.stddev_pop("residual").alias("_sd"))
    return out.join(F.broadcast(spread_of)).withColumn("normal", F.abs(F.col("residual") - F.col("_mean")) <= n_sigma * F.col("_sd")).drop("_i", "_m", "_mean", "_sd")


def cumulative(df: DataFrame, order: str, sums: Mapping[str, str], descending: bool = False) -> DataFrame:
    """Running sums over a table with one row per ``order`` value, by ranges of even size."""
    return running(df, order, sums, descending=descending)


def coverage_curve(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """By depth: groups and rows up to it as shares, and groups at or above it (WIN10)."""
    depth = df.groupBy(*group).agg(F.count(F.lit(1)).alias("depth"))
    per = depth.groupBy("depth").agg(F.count(F.lit(1)).alias("_g")).withColumn("_r", F.col("depth") * F.col("_g"))
    run = cumulative(per, "depth", {"g": "_g", "r": "_r"})
    total = per.agg(F.sum("_g").alias("_all_g"), F.sum("_r").alias("_all_r"))
    return run.join(F.broadcast(total)).select("depth", (F.col("g") / F.col("_all_g")).alias("group_share"), (F.col("r") / F.col("_all_r")).alias("row_share"), (F.col("_all_g") - F.col("g") + F.col("_g")).alias("groups_at_least"))


def in_large_groups(df: DataFrame, group: Sequence[str], above: int = 1) -> DataFrame:
    """Rows of groups with more than ``above`` rows, as they are (WIN11)."""
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > above).select(*group)
    return df.join(large, list(group), "left_semi")


def rank_groups(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Groups with their mean and its dense rank (WIN11). Means are written once: the last digit of a sum may change with
    the order of its parts, and a mean found anew would not meet its rank."""
    means = written(df.groupBy(*group).agg(F.avg(value).alias("mean")), "means")
    ranks = dense_index(means.select("mean").distinct(), ["mean"], "mean_rank", start=1).withColumnRenamed("mean", "_mean")
    return means.join(sized_broadcast(ranks), F.col("mean").eqNullSafe(F.col("_mean"))).drop("_mean")


def shift_correction(df: DataFrame, group: Sequence[str], frame: str, trench: str, x: str, threshold: float, into: str = "corrected") -> DataFrame:
    """Trench labels, one more in frames whose trench 0 starts at least ``threshold`` right of the group's least x (WIN13)."""
    low = F.min(x).over(Window.partitionBy(*group))
    first = F.max(F.when(F.col(trench) == 0, F.col(x))).over(Window.partitionBy(*group, frame))
    return df.withColumn(into, F.col(trench) + F.when(first - low >= threshold, 1).otherwise(0))


def drift(matches: DataFrame, group: Sequence[str], time: str, shift: str) -> DataFrame:
    """Median shift of each step and its running sum (WIN14). ``matches``: one row per object matched to the next frame."""
    per = matches.groupBy(*group, time).agg(F.percentile(shift, 0.5).alias("step"))
    return per.withColumn("drift", F.sum("step").over(Window.partitionBy(*group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)))


def ratio_filter(df: DataFrame, trace: Sequence[str], time: str, y: str, dt: int, low: float, high: float) -> DataFrame:
    """Traces all of whose y(t) / y(t + dt rows) stay within bounds: smallest and largest ratio (WIN15)."""
    later = F.lead(y, dt).over(Window.partitionBy(*trace).orderBy(time))
    per = df.withColumn("_r", F.try_divide(F.col(y), later)).groupBy(*trace).agg(F.min("_r").alias("min_ratio"), F.max("_r").alias("max_ratio"))
    return per.filter((F.col("min_ratio") >= low) & (F.col("max_ratio") <= high))


def gap_fill(df: DataFrame, group: Sequence[str], order: str, value: str, into: str = "filled", by_time: bool = True) -> DataFrame:
    """Nulls between known values on the line between them, by ``order`` or by row number; ends stay null (WIN16)."""
    w = Window.partitionBy(*group).orderBy(order)
    at = F.col(order).cast("double") if by_time else F.row_number().over(w).cast("double")
    rows = df.withColumn("_at", at)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("t"), F.col(value).alias("y")))
    past = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    next_ = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_p": past, "_n": next_})
    line = F.col("_p.y") + (F.col("_n.y") - F.col("_p.y")) * F.try_divide(F.col("_at") - F.col("_p.t"), F.col("_n.t") - F.col("_p.t"))
    return rows.withColumn(into, F.coalesce(F.col(value), line)).drop("_at", "_p", "_n")


def delta_from_min(df: DataFrame, group: Sequence[str], value: str, into: str = "delta") -> DataFrame:
    """Value less the group's least (WIN17)."""
    return df.withColumn(into, F.col(value) - F.min(value).over(Window.partitionBy(*group)))


def last_good_cycle(df: DataFrame, group: Sequence[str], cycle: str, clock: str) -> DataFrame:
    """The last cycle before the clock first stands still; the last cycle where it never does (WIN18)."""
    w = Window.partitionBy(*group).orderBy(cycle)
    stalled = F.when(F.col(clock) - F.lag(clock).over(w) == 0, F.lag(cycle).over(w))
    per = df.withColumn("_s", stalled).groupBy(*group).agg(F.min("_s").alias("_first"), F.max(cycle).alias("_last"))
    return per.select(*group, F.coalesce("_first", "_last").alias("last_good"))


def first_row_with_ids(df: DataFrame, group: Sequence[str], order: str, columns: Sequence[str], ids: str) -> DataFrame:
    """One row per group, its first, and the sorted ids of all its rows (WIN20)."""
    return df.groupBy(*group).agg(*[F.min_by(c, order).alias(c) for c in columns], F.array_sort(F.collect_list(ids)).alias("ids"))

"""Dense numbers, running values and exact quantiles without a one-task window.

Rows are put in order by range partitions of even size and written once with their partition's number; one row a
partition is added up first, then each partition runs on its own from there. Skewed values and large groups only make
more partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import sized_broadcast, written

ROWS_PER_PART = 200_000
#: The place of a row within its partition: the lower bits of monotonically_increasing_id.
_PLACE = (1 << 33) - 1


def in_ranges(df: DataFrame, order: Sequence[Column | str], rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``df`` in order, written, with ``_part`` (number of the row's range) and ``_place`` (in it, from 0)."""
    parts = max(1, -(-df.count() // rows_per_part))
    ordered = df.repartitionByRange(parts, *order) if parts > 1 else df.repartition(1)
    ordered = ordered.sortWithinPartitions(*order)
    return written(ordered.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}), "ranges")


def dense_index(df: DataFrame, order: Sequence[str], into: str, start: int = 0, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Adds ``into``: 0, 1, 2 ... in the order of ``order``, which must identify rows (WIN6)."""
    rows = in_ranges(df, list(order), rows_per_part)
    sums = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(sized_broadcast(sums), "_part").withColumn(into, (F.col("_place") + F.col("_base") + start).cast("long")).drop("_part", "_place", "_base")


def running(df: DataFrame, order: str, sums: Mapping[str, str] = {}, mins: Mapping[str, str] = {}, group: Sequence[str] = (), descending: bool = False, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Running sums and minima, the row itself included, by ``order`` within each group: one row per group and
    ``order`` value. ``sums`` and ``mins`` map new names to columns."""
    key = F.desc if descending else F.asc
    rows = in_ranges(df, [*group, key(order)], rows_per_part)
    per = rows.groupBy(*group, "_part").agg(*[F.sum(v).alias(f"_base_{k}") for k, v in sums.items()], *[F.min(v).alias(f"_base_{k}") for k, v in mins.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = {f"_base_{k}": F.coalesce(F.sum(f"_base_{k}").over(before), F.lit(0)) for k in sums} | {f"_base_{k}": F.min(f"_base_{k}").over(before) for k in mins}
    per = per.withColumns(bases).select(*[F.col(g).alias(f"_own_{g}") for g in group], F.col("_part").alias("_p"), *bases)
    inside = Window.partitionBy(*group, "_part").orderBy(key(order)).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({k: F.sum(v).over(inside) for k, v in sums.items()} | {k: F.min(v).over(inside) for k, v in mins.items()})
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_own_{g}"))
    joined = run.join(sized_broadcast(per), same)
    joined = joined.withColumns({k: F.col(k) + F.col(f"_base_{k}") for k in sums} | {k: F.least(F.col(k), F.col(f"_base_{k}")) for k in mins})
    return joined.drop("_part", "_place", "_p", *[f"_own_{g}" for g in group], *bases)


def around_on_line(asking: DataFrame, marks: DataFrame, group: Sequence[str], at: str, mark: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``asking`` with ``before`` and ``after``: the marks next to each row by ``at`` within its group, as struct(at, mark),
    null where there is none; a mark at the row's own place is before it. ``marks``: group, at, mark, one mark a place.
    Ranges of rows of both kinds run on their own; a range gets the marks next to it from one row a range."""
    names = [c for c in asking.columns if c not in (*group, at)]
    both = asking.select(*group, at, F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(marks.schema[mark].dataType).alias("_mark"))
    both = both.unionByName(marks.select(*group, at, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(mark).alias("_mark")))
    rows = in_ranges(both, [*group, at, "_side"], rows_per_part)
    here = F.when(F.col("_side") == 0, F.struct(F.col(at).alias("at"), F.col("_mark").alias("mark")))
    rows = rows.withColumn("_here", here)
    per = rows.groupBy(*group, "_part").agg(F.max("_here").alias("_last"), F.min("_here").alias("_first"))
    earlier = lambda *order: Window.partitionBy(*group, *order[1:]).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)
    # what follows is what comes earlier in the reverse order: a frame that ends at the last row is added up anew for each row
    per = per.withColumns({"_up_to": F.last("_last", ignorenulls=True).over(earlier("_part")), "_from": F.last("_first", ignorenulls=True).over(earlier(F.desc("_part")))})  # one row a range
    per = per.select(*[F.col(g).alias(f"_own_{g}") for g in group], F.col("_part").alias("_p"), "_up_to", "_from")
    rows = rows.withColumns({"before": F.last("_here", ignorenulls=True).over(earlier("_place", "_part")), "after": F.last("_here", ignorenulls=True).over(earlier(F.desc("_place"), "_part"))})
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_own_{g}"))
    out = rows.filter("_side = 1").join(sized_broadcast(per), same)
    return out.select(*group, at, "_row.*", F.coalesce("before", "_up_to").alias("before"), F.coalesce("after", "_from").alias("after"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], group: Sequence[str] = (), into: str = "quantiles", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The groups with ``into``: the exact quantiles of their values, linear between neighbours; nulls do not count.

    For few large groups. Equal values are counted first; then only distinct values are put in order, and no group or
    column meets in one task. Without group columns there is one row, with nulls for no values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    run = running(counts, "_v", {"_cum": "_k"}, group=group, rows_per_part=rows_per_part)
    total = run.groupBy(*group).agg(F.max("_cum").alias("_total"))
    if group:
        total = total.select(*[F.col(g).alias(f"_own_{g}") for g in group], "_total")
        same = F.lit(True)
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_own_{g}"))
        joined = run.join(sized_broadcast(total), same)
    else:
        joined = run.join(F.broadcast(total))  # one row
    at = [(F.col("_total") - 1) * F.lit(float(q)) for q in shares]
    first = lambda place: F.min(F.when(F.col("_cum") > place, F.col("_v")))
    found = joined.groupBy(*group).agg(F.max("_total").alias("_total"), *[first(F.floor(a)).alias(f"_lo{i}") for i, a in enumerate(at)], *[first(F.ceil(a)).alias(f"_hi{i}") for i, a in enumerate(at)])
    between = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (a - F.floor(a)) for i, a in enumerate(at)]
    return found.select(*group, F.array(*between).alias(into))

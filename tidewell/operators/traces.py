"""Traces and vectors over time (TSR1-5, TSR7, AGG22, AGG23)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import sized_broadcast, written


def kernel_traces(df: DataFrame, group: Sequence[str], time: str, values: Sequence[str], grid: Sequence[float], bandwidth: float) -> DataFrame:
    """Gaussian kernel regression onto a time grid, one array per value column (TSR1).

    Every grid point is a pair of weighted sums in one aggregate, so sums combine before the shuffle and no rows are
    multiplied. Points without weight are null; a null value counts for no trace.
    """
    weight = lambda g: F.exp(-F.pow((F.col(time) - g) / bandwidth, 2) / 2)
    aggs = []
    for v in values:
        known = F.col(v).isNotNull() & F.col(time).isNotNull()
        points = [F.try_divide(F.sum(weight(g) * F.col(v)), F.sum(F.when(known, weight(g)))) for g in grid]
        aggs.append(F.array(*points).alias(v))
    return df.groupBy(*group).agg(*aggs, F.count(F.lit(1)).alias("n_observations"))


def feature_matrix(traces: DataFrame, features: Sequence[str], into: str = "feature_vector") -> DataFrame:
    """Traces stacked in a fixed order, rows with a missing or NaN point dropped (TSR2)."""
    bad = lambda x: x.isNull() | F.isnan(x)
    good = traces
    for f in features:
        good = good.filter(F.col(f).isNotNull() & ~F.exists(f, bad))
    return good.withColumn(into, F.array(*[F.col(f) for f in features])).drop(*features)


def fluctuation_bins(df: DataFrame, trace: str, time: str, y: str, width: float, above: int) -> DataFrame:
    """Traces binned by their first value: per bin and time n, mean, variance, mean share p, their ratio to p(1 - p) (AGG22).

    Bins of more than ``above`` traces. p is y over the trace's first value; traces that start at 0 have none.
    """
    first = F.min_by(y, time)
    starts = df.groupBy(trace).agg(first.alias("y0")).withColumn("bin", F.floor(F.col("y0") / width).cast("long"))
    large = starts.groupBy("bin").agg(F.count(F.lit(1)).alias("n_traces"), F.avg("y0").alias("mean0")).filter(F.col("n_traces") > above)
    rows = df.join(starts, trace).join(sized_broadcast(large), "bin").withColumn("p", F.try_divide(y, "y0"))
    out = rows.groupBy("bin", time).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("variance"), F.avg("p").alias("p"), F.first("mean0").alias("mean0"))
    return out.withColumn("scaled_variance", F.try_divide("variance", "mean0")).withColumn("ratio", F.try_divide("scaled_variance", F.col("p") * (1 - F.col("p")))).drop("mean0")


def robust_variance(df: DataFrame, group: Sequence[str], y: str, few_groups: bool = False) -> DataFrame:
    """(1.4826 MAD)^2 per group (AGG23); ``few_groups`` as in ``median_by``."""
    from .stats import mad_bands

    return mad_bands(df, group, y, few_groups).select(*group, "median", F.pow(F.col("mad") * 1.4826, 2).alias("robust_variance"))


def within_robust_sigma(df: DataFrame, group: Sequence[str], y: str, n_sigma: float = 3.0) -> DataFrame:
    """Rows within n_sigma robust deviations of their group's median (AGG23)."""
    from .stats import mad_bands

    bands = mad_bands(df, group, y).select(*group, F.col("median").alias("_m"), (F.col("mad") * 1.4826).alias("_s"))
    return df.join(bands, list(group)).filter(F.abs(F.col(y) - F.col("_m")) <= n_sigma * F.col("_s")).drop("_m", "_s")


def neighbour_steps(objects: DataFrame, group: Sequence[str], time: str, key: str, x: str, y: str, size: str) -> DataFrame:
    """Each object's nearest at the next time: neighbour, distance over the root of its size, relative size change (TSR7).

    Sizes go along with their objects, so nothing is joined back. Objects are written once and read as both sides."""
    from .joins import placed
    from .neighbours import nearest_points

    now = written(objects.filter(placed([x, y])).select(*group, time, key, x, y, F.col(size).alias("_own")), "objects")
    later = now.select(*group, (F.col(time) - 1).alias(time), F.col(key).alias("neighbour"), x, y, F.col("_own").alias("_s"))
    best = nearest_points(now, later, [*group, time], key, "neighbour", [x, y], left_keep=["_own"], right_keep=["_s"])
    return best.select(*group, time, key, "neighbour", F.try_divide(F.sqrt("distance2"), F.sqrt("_own")).alias("distance"), F.try_divide(F.col("_s") - F.col("_own"), F.col("_own")).alias("size_change"))


def trench_lineages(cells: DataFrame, group: Sequence[str], time: str, position: str, length: str, buffer: float = 0.0, at_edge: str | None = None) -> DataFrame:
    """Binary lineage ids of cells ordered along a trench (TSR6).

    Cells of a frame are matched in order to those of the frame before. Where a cell is shorter than its predecessor by
    more than ``buffer``, that one has divided: it and the next cell are its children 2n and 2n + 1; a predecessor that
    touches the image's edge (column ``at_edge``) has not, since it may have slid out. Each cell of the first frame
    starts a lineage of its own with id 1; cells pushed out at the open end go unmatched. Cells beyond all predecessors
    start new lineages. Cells come sorted by trench, frame and place; of a trench only the frame before and the one at hand
    are held, whatever batches the rows come in. Rows without a time stand in no frame and have no row.
    """
    kept = [*group, time, position]
    kind = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in kept)
    order = [time, F.asc_nulls_last(position)]
    w = Window.partitionBy(*group).orderBy(*order)
    edge = F.coalesce(F.col(at_edge).cast("boolean"), F.lit(False)) if at_edge else F.lit(False)
    timed = cells.filter(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double")) if cells.schema[time].dataType.typeName() in ("float", "double") else F.col(time).isNotNull())
    rows = timed.select(*kept, F.coalesce(F.col(length).cast("double"), F.lit(float("nan"))).alias("_size"), edge.alias("_edge"))
    rows = rows.withColumns({"_first": F.row_number().over(w) == 1, "_frame": ~F.col(time).eqNullSafe(F.lag(time).over(w))})
    rows = rows.sortWithinPartitions(*group, *order)  # as the window leaves them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now, at, twin, lineages = [], [], 0, None, 0
        for batch in batches:
            lins, nodes = [], []
            for first, frame, size, edge in zip(*(batch.column(c).to_pylist() for c in ("_first", "_frame", "_size", "_edge"))):
                if first:
                    before, now, at, twin, lineages = [], [], 0, None, 0
                elif frame:
                    before, now, at, twin = now, [], 0, None
                if twin:
                    (lin, node), twin = twin, None
                elif at < len(before):
                    lin, node, was, touched = before[at]
                    at += 1
                    if size + buffer < was and not touched:
                        node, twin = 2 * node, (lin, 2 * node + 1)
                else:
                    lin, node = lineages, 1
                    lineages += 1
                now.append((lin, node, size, edge))
                lins.append(lin)
                nodes.append(node)
            columns = [*(batch.column(c) for c in kept), pa.array(lins, pa.int64()), pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lineage", "progeny_id"])

    return rows.mapInArrow(run, f"{kind}, lineage long, progeny_id long")

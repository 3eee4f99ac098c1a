"""Joins: maps between point sets, families, overlaps, lookups (JON4, JON7-20, JON22, JON23)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized_broadcast
from .neighbours import nearest_points
from .numbering import around_on_line


def exact_lookup(queries: DataFrame, codebook: DataFrame, barcode: str) -> DataFrame:
    """Queries whose barcode stands in the codebook, with its columns (JON4)."""
    return queries.join(sized_broadcast(codebook), barcode)


def placed(coords: Sequence[str]) -> Column:
    """Whether a row has all its coordinates: none null, none NaN."""
    return reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords])


def nearest(left: DataFrame, right: DataFrame, group: Sequence[str], left_id: str, right_id: str, coords: Sequence[str], within: float | None = None) -> DataFrame:
    """(group, left_id, right_id, distance2): each left point's nearest right point of its group, ties to the smaller id;
    left points without one (at most ``within`` away) are left out. Rows with a null or NaN coordinate have no place.

    On a line, the marks next to each point; in more dimensions, leaves of k-d trees (``nearest_points``): no pair of a
    whole group is made.
    """
    known = placed(coords)
    left, right = left.filter(known).select(*group, left_id, *coords), right.filter(known).select(*group, right_id, *coords)
    names = [*group, left_id, right_id, "distance2"]
    bound = F.lit(True) if within is None else F.col("distance2") <= within * within
    if len(coords) == 1:
        at = coords[0]
        marks = right.groupBy(*group, at).agg(F.min(right_id).alias(right_id))
        out = around_on_line(left, marks, group, at, right_id)
        far = lambda m: F.when(m.isNotNull(), F.struct(((F.col(at) - m["at"]) * (F.col(at) - m["at"])).alias("d"), m["mark"].alias("id")))
        best = F.array_min(F.array_compact(F.array(far(F.col("before")), far(F.col("after")))))
        out = out.withColumn("_b", best).filter("_b is not null")
        return out.select(*group, left_id, F.col("_b.id").alias(right_id), F.col("_b.d").alias("distance2")).filter(bound)
    return nearest_points(left, right, group, left_id, right_id, coords, within).select(*names)


def mutual_nearest(a: DataFrame, b: DataFrame, group: Sequence[str], a_id: str, b_id: str, coords: Sequence[str], offset: Sequence[float] | None = None, within: float | None = None) -> DataFrame:
    """Pairs (group, a_id, b_id, distance2) that choose each other as nearest inside a group, ties to the smaller id
    (JON7, JON23). ``offset`` is added to a's coordinates; ``within`` bounds the distance."""
    offset = offset or [0.0] * len(coords)
    moved = a.select(*group, a_id, *[(F.col(c) + o).alias(c) for c, o in zip(coords, offset)])
    of_a = nearest(moved, b, group, a_id, b_id, coords, within)
    of_b = nearest(b, moved, group, b_id, a_id, coords, within).drop("distance2")
    return of_a.join(of_b, [*group, a_id, b_id])


def barcode_phenotype(phenotype: DataFrame, barcode: DataFrame, mapping: DataFrame, pheno_id: str, barcode_id: str, drop: Sequence[str] = ()) -> DataFrame:
    """Barcode columns put to phenotype rows through a map of ids (JON8)."""
    mapped = mapping.select(pheno_id, barcode_id).join(barcode.drop(*drop), barcode_id)
    return phenotype.join(mapped, pheno_id)


def lookup_or(df: DataFrame, keys: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    """``value`` from a lookup, ``default`` where there is none (JON9)."""
    return df.join(keys.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def first_last(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The first and the last row of each group: first_<c>, last_<c> (WIN1), by aggregates, without a sort."""
    o = F.struct(*order)
    return df.groupBy(*group).agg(*[f.alias(n) for c in columns for f, n in ((F.min_by(c, o), f"first_{c}"), (F.max_by(c, o), f"last_{c}"))])


def family_join(cells: DataFrame, table: DataFrame, cell: str, relatives: Mapping[str, str], columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Columns of each cell's relatives beside its own: <relation>_<column> (JON10). ``relatives`` maps a relation's
    name to the column that holds its id; ``within`` are columns a family shares, which keep the joins co-partitioned."""
    out = cells
    for relation, column in relatives.items():
        other = table.select(*within, F.col(cell).alias(column), *[F.col(c).alias(f"{relation}_{c}") for c in columns])
        out = out.join(other, [*within, column], "left")
    return out


def replace_from(df: DataFrame, other: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``column`` from ``other`` where it has the key (JON12)."""
    new = other.select(*keys, F.col(column).alias("_new"))
    return df.join(new, list(keys), "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Columns of ``other`` by key (JON11, JON13, JON14)."""
    return df.join(other.select(*keys, *columns), list(keys), how)


def place_regions(regions: DataFrame, offsets: DataFrame, cells: DataFrame, offset_keys: Sequence[str], cell_keys: Sequence[str], shift: Mapping[str, str]) -> DataFrame:
    """Cells with their region's stage position (JON14): regions without an offset stay, unmoved; cells without a region
    go. ``shift`` maps a region's coordinate to the column of ``offsets`` that is added to it."""
    moved = regions.join(offsets.select(*offset_keys, *[F.col(o).alias(f"_{o}") for o in shift.values()]), list(offset_keys), "left")
    moved = moved.withColumns({c: F.col(c) + F.coalesce(F.col(f"_{o}"), F.lit(0)) for c, o in shift.items()}).drop(*[f"_{o}" for o in shift.values()])
    return cells.join(moved, list(cell_keys))


def overlap_summary(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in a, in b and in both, with their share (JON15). A key twice on one side is an error."""

    def once(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy(key).agg(F.when(n > 1, F.raise_error(F.lit(f"a key stands twice in {side}")).cast("boolean")).otherwise(True).alias(f"in_{side}"))

    counts = once(a, "a").join(once(b, "b"), key, "full").groupBy(F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("in_a", "in_b", "n", (F.col("n") / F.col("total")).alias("share"))


def in_all(df: DataFrame, keys: Sequence[DataFrame], on: str) -> DataFrame:
    """Rows whose key stands in every one of the key sets (JON16)."""
    for k in keys:
        df = df.join(k.select(on), on, "left_semi")
    return df


def in_none(df: DataFrame, keys: Sequence[DataFrame], on: str) -> DataFrame:
    """Rows whose key stands in none of the key sets (JON17)."""
    for k in keys:
        df = df.join(k.select(on), on, "left_anti")
    return df


def assemble_codebook(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Inner join of all parts by key; a key that some part lacks is an error (JON18)."""
    out = parts[0].withColumn("_have", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_new", F.lit(1)), key, "full").withColumn("_have", F.col("_have") + F.col("_new")).drop("_new")
    return out.withColumn(key, F.when(F.col("_have").isNull(), F.raise_error(F.lit("a part of the codebook lacks a key")).cast(parts[0].schema[key].dataType)).otherwise(F.col(key))).drop("_have")


def annotate_guides(guides: DataFrame, design: DataFrame, sequence: str, category: str, excluded: Sequence[str]) -> DataFrame:
    """Design columns by guide sequence, without the excluded categories (JON19)."""
    return guides.join(design.filter(~F.col(category).isin(*excluded)), sequence)


def lone_points(df: DataFrame, group: Sequence[str], key: str, x: str, y: str, min_dist: float, intensity: str | None = None, factor: float = 2.0) -> DataFrame:
    """Points without a neighbour nearer than ``min_dist`` and no brighter than ``factor`` times the group's median
    (JON20). Points of one grid cell, whose diagonal is shorter than that, all have a neighbour; only a point alone in its
    cell meets the points of the cells around, so that a point is met at most once for each of 24 cells, however dense."""
    side = 0.7 * min_dist
    cell = lambda c: F.floor(F.col(c) / side)
    known = reduce(and_, [F.col(c).isNotNull() for c in [*group, key]])
    finite = reduce(and_, [F.abs(F.col(c).cast("double")) < float("inf") for c in (x, y)])  # not null, not NaN
    placed = df.filter(known & finite).select(*group, key, x, y, cell(x).alias("_cx"), cell(y).alias("_cy"))
    at = [*group, "_cx", "_cy"]
    cells = placed.groupBy(*at).agg((F.min(key) == F.max(key)).alias("_alone"))
    marked = placed.join(cells, at)
    around = F.explode(F.expr("filter(flatten(transform(sequence(-2, 2), i -> transform(sequence(-2, 2), j -> struct(i as i, j as j)))), s -> s.i <> 0 or s.j <> 0)")).alias("_s")
    alone = marked.filter("_alone").select(*group, F.col(key).alias("_k"), F.col(x).alias("_x"), F.col(y).alias("_y"), "_cx", "_cy", around)
    alone = alone.select(*group, "_k", "_x", "_y", (F.col("_cx") + F.col("_s.i")).alias("_cx"), (F.col("_cy") + F.col("_s.j")).alias("_cy"))
    near = placed.join(alone, at).filter((F.col(key) != F.col("_k")) & (F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y")) < min_dist))
    near = near.select(*group, F.col("_k").alias(key)).unionByName(marked.filter(~F.col("_alone")).select(*group, key)).distinct()
    out = df.join(near, [*group, key], "left_anti")
    if intensity:
        mid = df.groupBy(*group).agg(F.percentile(intensity, 0.5).alias("_mid"))
        out = out.join(sized_broadcast(mid), list(group)).filter(F.col(intensity) <= factor * F.col("_mid")).drop("_mid")
    return out


def nearest_reference(df: DataFrame, seq: str, references: DataFrame, position: str) -> DataFrame:
    """Each sequence's reference at its position with fewest mismatches, ties to the smaller name (JON22).

    ``references``: position, name, ref; a handful for each position.
    """
    from ..functions.sequences import hamming

    pairs = df.join(sized_broadcast(references.select(position, "name", "ref")), position)
    best = F.min(F.struct(hamming(F.col(seq), F.col("ref")).alias("mismatches"), F.col("name").alias("call"))).alias("_best")
    return pairs.groupBy(*df.columns).agg(best).select(*df.columns, "_best.call", "_best.mismatches")


def percent_agreeing(df: DataFrame, group: Sequence[str], call: str, group_call: str) -> DataFrame:
    """Percent of a group's rows whose call is the group's own."""
    return df.groupBy(*group).agg((100 * F.avg(F.when(F.col(call) == F.col(group_call), 1.0).otherwise(0.0))).alias("percent_agreeing"))

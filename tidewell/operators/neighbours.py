"""Nearest points by k-d leaves, and nearest vectors by pivots (JON7, JON20, JON23, TSR3, TSR4, TSR7)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import sized_broadcast, written
from .numbering import in_ranges

#: Points of a leaf, sampled points a leaf, and leaves of all trees together, at most; groups up to so many points are joined.
LEAF, SAMPLED, LEAVES = 2_048, 16, 250_000
JOINED = 64
#: Points of a cell within a leaf, and pairs of points compared at once.
CELL, PAIRS = 128, 32_768
#: Asking points that meet one copy of a leaf, and queries that meet one copy of a block of vectors.
ASKING = 50_000
QUERIES = 1_000_000


@dataclass
class Tree:
    """Cuts of space into leaves: node i is cut in ``dim[i]`` at ``at[i]``; its children are 2i+1 (up to the cut) and 2i+2.
    Leaves are the nodes of the last level; a cut at infinity leaves its right side empty."""

    dim: np.ndarray
    at: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, n_leaves: int) -> Tree:
        depth = max(0, int(np.ceil(np.log2(max(1, n_leaves)))))
        dim, at = np.zeros(2**depth - 1, np.int8), np.full(2**depth - 1, np.inf)
        parts = {0: points}
        for i in range(len(dim)):
            p = parts.pop(i)
            if len(p):
                d = int(np.argmax(np.ptp(p, axis=0)))
                cut = float(np.quantile(p[:, d], 0.5, method="lower"))
                dim[i], at[i] = d, cut if p[:, d].max() > cut else np.inf
                parts[2 * i + 1], parts[2 * i + 2] = p[p[:, d] <= at[i]], p[p[:, d] > at[i]]
            else:
                parts[2 * i + 1] = parts[2 * i + 2] = p
        return cls(dim, at)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(int(np.log2(len(self.dim) + 1))):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dim[node]] > self.at[node])
        return node - len(self.dim)

    def reached(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all leaves that a ball around a point touches."""
        found, todo = [], [(0, np.arange(len(points)))]
        while todo:
            node, of = todo.pop()
            if not len(of):
                continue
            if node >= len(self.dim):
                found.append((of, np.full(len(of), node - len(self.dim))))
                continue
            x = points[of, self.dim[node]]
            todo += [(2 * node + 1, of[x - radius[of] <= self.at[node]]), (2 * node + 2, of[x + radius[of] > self.at[node]])]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def _closest_of_all(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of ``c`` closest to each row of ``q``, and its squared distance, by all pairs."""
    best, d2 = np.empty(len(q), np.int64), np.empty(len(q))
    columns, size = [np.ascontiguousarray(c[:, k]) for k in range(c.shape[1])], max(1, PAIRS // len(c))
    for s in range(0, len(q), size):
        part = 0.0
        for k, x in enumerate(columns):
            step = q[s : s + size, k, None] - x
            part = part + step * step
        best[s : s + size] = part.argmin(1)
        d2[s : s + size] = part[np.arange(len(part)), best[s : s + size]]
    return best, d2


def _closest(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of ``c`` closest to each row of ``q``, and its squared distance. Rows of ``c`` stand in cells of even
    size, strips along the widest coordinate cut along the next; a row of ``q`` first meets the nearest cell, and then only
    cells whose box is no farther than what it has found."""
    n = int(np.sqrt(len(c) // CELL))
    if n < 2 or c.shape[1] < 2 or not (np.isfinite(q).all() and np.isfinite(c).all()):
        return _closest_of_all(q, c)
    u, v = np.argsort(-np.ptp(c, axis=0), kind="stable")[:2]
    strip = np.empty(len(c), np.int64)
    strip[np.argsort(c[:, u], kind="stable")] = np.arange(len(c)) * n // len(c)
    order, sizes = np.lexsort((c[:, v], strip)), np.bincount(strip, minlength=n)
    strip = strip[order]
    cell = strip * n + (np.arange(len(c)) - (np.cumsum(sizes) - sizes)[strip]) * n // sizes[strip]
    at = np.searchsorted(cell, np.arange(n * n + 1))
    low, high = np.minimum.reduceat(c[order], at[:-1]), np.maximum.reduceat(c[order], at[:-1])
    gap = np.zeros((n * n, len(q)))  # found as distances are, so that it never exceeds one by rounding
    for k in range(c.shape[1]):
        step = np.maximum(np.maximum(low[:, k, None] - q[:, k], q[:, k] - high[:, k, None]), 0)
        gap += step * step
    first, best, d2 = gap.argmin(0), np.full(len(q), len(c)), np.full(len(q), np.inf)
    for again in (False, True):
        for j in range(n * n):
            of = np.flatnonzero((gap[j] <= d2) & (first != j) if again else first == j)
            if len(of):
                rows = np.sort(order[at[j] : at[j + 1]])
                near, d = _closest_of_all(q[of], c[rows])
                near = rows[near]
                less = (d < d2[of]) | ((d == d2[of]) & (near < best[of]))
                best[of[less]], d2[of[less]] = near[less], d[less]
    return best, d2


def nearest_points(
    left: DataFrame, right: DataFrame, group: Sequence[str], left_id: str, right_id: str, coords: Sequence[str], within: float | None = None,
    left_keep: Sequence[str] = (), right_keep: Sequence[str] = (),
) -> DataFrame:
    """(group, left_id, right_id, distance2) in two dimensions or more: each left point's nearest right point of its group,
    ties to the smaller id, at most ``within`` away; beside them ``left_keep`` of the left point and ``right_keep`` of the
    right one.

    Groups of few right points stand in one list each, which every left point of the group meets in its own row. In larger
    ones, right points of one place stand for one; they are cut into leaves of even
    size by k-d trees over a sample (16 points a leaf): a left point first meets its own leaf, whose nearest point bounds the
    distance, and then only the leaves that the ball of this radius touches; within a leaf, it meets the cells near it. Each
    point finds the leaves it touches in the task that found its bound. A far point stretches one leaf, no other. Trees are held by every task: at most 250,000 leaves together, which grow beyond 500 million points. A leaf that many points
    ask for is copied to several tasks.
    """
    if not group:
        left, right = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))
        return nearest_points(left, right, ["_all"], left_id, right_id, coords, within, left_keep, right_keep).drop("_all")
    group, coords = list(group), list(coords)
    spark = left.sparkSession
    kind = right.schema[right_id].dataType.simpleString()
    place = [*group, *coords]
    points = right
    large = written(right.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > JOINED), "large")
    any_large = not large.isEmpty()
    few_left, few_right = left, right
    if any_large:
        held = sized_broadcast(large.select(*group))
        few_left, few_right = (t.join(held, group, "left_anti") for t in (left, right))
        left, right = (t.join(held, group, "left_semi") for t in (left, right))
    listed = few_right.groupBy(*group).agg(F.collect_list(F.struct(*coords, F.col(right_id).alias("_id"), *[F.col(c).alias(f"_kept_{c}") for c in right_keep])).alias("_there"))
    d2 = lambda r: sum(((F.col(c) - r[c]) * (F.col(c) - r[c]) for c in coords), F.lit(0.0))
    met = F.array_min(F.transform("_there", lambda r: F.struct(d2(r).alias("_d"), r["_id"].alias("_id"), *[r[f"_kept_{c}"].alias(f"_kept_{c}") for c in right_keep])))
    few = few_left.select(*dict.fromkeys([*group, left_id, *coords, *left_keep])).join(listed, group).withColumn("_m", met)
    few = few if within is None else few.filter(F.col("_m._d") <= within * within)
    few = few.select(*group, left_id, F.col("_m._id").alias(right_id), F.col("_m._d").alias("distance2"), *left_keep, *[F.col(f"_m._kept_{c}").alias(c) for c in right_keep])
    if not any_large:
        return few
    right = written(right.groupBy(*place).agg(F.min(right_id).alias("_id")), "places")
    asked = left.select(*place).distinct()
    many = written(right.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), "counts")
    settled = best = right.select(*place, F.lit(0.0).alias("_d"), "_id").limit(0)

    total = many.agg(F.sum("_n")).first()[0] or 0
    if total:
        leaf = max(LEAF, -(-total // LEAVES))
        many = many.withColumn("_leaves", F.ceil(F.col("_n") / leaf))
        rows = right.join(sized_broadcast(many), group)
        drawn = rows.filter(F.pmod(F.xxhash64(*coords), F.lit(1 << 20)) < F.lit(float(SAMPLED << 20)) * F.col("_leaves") / F.col("_n"))
        sample = drawn.select(*group, "_leaves", *[F.col(c).cast("double").alias(c) for c in coords])

        def grown(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = Tree.over(pdf[coords].to_numpy(float), int(pdf["_leaves"].iloc[0]))
            return pdf[group].iloc[:1].assign(_dim=[tree.dim.tobytes()], _at=[tree.at.tobytes()])

        kinds = ", ".join([*[f"`{g}` {right.schema[g].dataType.simpleString()}" for g in group], "_dim binary", "_at binary"])
        # groups whose sample is empty are one leaf
        trees = written(sample.groupBy(*group).applyInPandas(grown, kinds), "trees")
        trees = many.join(trees, group, "left")
        listed, first, known = [], 0, []
        for i, r in enumerate(trees.collect()):  # at most LEAVES cuts
            tree = Tree(np.frombuffer(r["_dim"] or b"", np.int8), np.frombuffer(r["_at"] or b"", "<f8"))
            listed.append((tree, first))
            known.append((*[r[g] for g in group], i))
            first += len(tree.dim) + 1
        shared = spark.sparkContext.broadcast(listed)
        numbered = spark.createDataFrame(known, T.StructType([*[right.schema[g] for g in group], T.StructField("_tree", T.IntegerType())]))

        @F.pandas_udf("long")
        def leaf_of(tree: pd.Series, at: pd.DataFrame) -> pd.Series:
            points, out = at.to_numpy(float), np.zeros(len(at), np.int64)
            for t, of in tree.groupby(tree).indices.items():
                out[of] = shared.value[t][0].leaf(points[of]) + shared.value[t][1]
            return pd.Series(out)

        xs = F.struct(*[F.col(c).cast("double").alias(c) for c in coords])
        numbered, firsts = sized_broadcast(numbered), np.array([x for _, x in listed])
        there = written(right.join(numbered, group).select("_id", *[F.col(c).cast("double").alias(f"_r{k}") for k, c in enumerate(coords)], leaf_of("_tree", xs).alias("_leaf")), "leaves")
        here = written(asked.join(numbered, group).withColumn("_leaf", leaf_of("_tree", xs)).drop("_tree"), "asking")

        def touched(points: np.ndarray, d2: np.ndarray, leaf: int) -> pa.ListArray:
            """The other leaves that each point's ball touches, of points of one leaf."""
            tree, start = shared.value[int(np.searchsorted(firsts, leaf, "right")) - 1]
            radius = np.sqrt(d2) * (1 + 1e-9) + 1e-300
            who, what = tree.reached(points, radius if within is None else np.minimum(radius, within * (1 + 1e-9)))
            who, what = who[what + start != leaf], what[what + start != leaf] + start
            order = np.argsort(who, kind="stable")
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(who[order], np.arange(len(points) + 1)), pa.int32()), pa.array(what[order], pa.int64()))

        def meet(asking: DataFrame, own: bool) -> DataFrame:
            """What asking points (with _leaf) find there, and in their own leaf also which others they touch. A leaf goes to
            as many tasks as its points ask for."""
            loads = asking.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("_parts"))
            parts = written(loads, "loads")
            left = asking.join(parts, "_leaf").withColumn("_part", F.pmod(F.xxhash64(*coords), F.col("_parts")).cast("int")).select(*place, *[F.col(c).cast("double").alias(f"_q{k}") for k, c in enumerate(coords)], "_leaf", "_part")
            copies = there.join(parts, "_leaf").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
            points = lambda t, name: np.stack([t.column(f"{name}{k}").to_numpy() for k in range(len(coords))], 1)

            def run(q: pa.Table, c: pa.Table) -> pa.Table:
                asks = points(q, "_q")
                if c.num_rows:
                    c = c.sort_by("_id")
                    near, d = _closest(asks, points(c, "_r"))
                    ids, far = c.column("_id").take(pa.array(near)), pa.array(d)
                else:  # a leaf without points
                    d = np.full(len(asks), np.inf)
                    ids, far = pa.nulls(len(asks), c.schema.field("_id").type), pa.nulls(len(asks), pa.float64())
                others = [touched(asks, d, (q if q.num_rows else c).column("_leaf")[0].as_py())] if own else []
                return pa.table([*[q.column(p) for p in place], far, ids, *others], names=[*place, "_d", "_id", *["_others"] * own])

            kinds = ", ".join([*[f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in place], "_d double", f"_id {kind}", *["_others array<bigint>"] * own])
            return left.groupBy("_leaf", "_part").cogroup(copies.groupBy("_leaf", "_part")).applyInArrow(run, kinds)

        first = written(meet(here, True), "own")
        sent = written(first.select(*place, F.explode("_others").alias("_leaf")), "sent")
        settled = first.filter(F.size("_others") == 0).drop("_others")
        best = first.filter(F.size("_others") > 0).drop("_others").unionByName(meet(sent, False))
    best = best.filter("_id is not null").groupBy(*place).agg(F.min(F.struct("_d", "_id")).alias("_m"))
    best = best.unionByName(settled.filter("_id is not null").select(*place, F.struct("_d", "_id").alias("_m")))
    if within is not None:
        best = best.filter(F.col("_m._d") <= within * within)
    best = left.select(*dict.fromkeys([*group, left_id, *coords, *left_keep])).join(best, place).select(*group, left_id, F.col("_m._id").alias(right_id), F.col("_m._d").alias("distance2"), *left_keep)
    if right_keep:
        kept = points.join(held, group, "left_semi").groupBy(*group, right_id).agg(F.min(F.struct(*right_keep)).alias("_kept"))
        best = best.join(kept, [*group, right_id]).select(*best.columns, *[F.col(f"_kept.`{c}`").alias(c) for c in right_keep])
    return few.unionByName(best)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """So many rows that lie far from one another: each next one is the farthest from those chosen."""
    chosen = [int(np.argmax(((sample - sample.mean(0)) ** 2).sum(1)))]
    away = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows to few, from differences: products would lose digits far from the origin."""
    return np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in y], 1)


class Nearest:
    """The k nearest of a block (id, v) for batches of queries, a query's own id left out, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.v, self.k, self.middle = ids[order], v[order], k, v.mean(0)
        self.near = self.v - self.middle
        self.square = (self.near**2).sum(1)

    def of(self, asked: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the batch, id, distance)."""
        out = []
        for s in range(0, len(q), 512):
            x = q[s : s + 512]
            m = x - self.middle
            d2 = (m**2).sum(1)[:, None] + self.square[None, :] - 2 * m @ self.near.T
            d2[asked[s : s + 512, None] == self.ids[None, :]] = np.inf
            reach = min(self.k + 8, len(self.ids))
            near = np.sort(np.argpartition(d2, reach - 1, axis=1)[:, :reach], axis=1)
            d = np.sqrt(((self.v[near] - x[:, None, :]) ** 2).sum(2))
            d[~np.isfinite(np.take_along_axis(d2, near, 1))] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, : self.k]
            d, ids = np.take_along_axis(d, order, 1), self.ids[np.take_along_axis(near, order, 1)]
            row, col = np.nonzero(np.isfinite(d))
            out.append((row + s, ids[row, col], d[row, col]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks_by_pivots(rows: DataFrame, block: int, n_pivots: int) -> tuple[DataFrame, list, np.ndarray]:
    """``rows`` (id, v) with b, the number of their block; of each block its number and the least and largest distances of
    its rows to every pivot; the pivots, from a sample of about 2,000 rows. Rows stand with their nearest pivot, in the
    order of their distance to it, in runs of about ``block``."""
    n = rows.count()
    sample = [r["v"] for r in rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, 2_000 / max(1, n)))).select("v").collect()]
    pivots = _pivots(np.array(sample or [r["v"] for r in rows.select("v").take(1)]), n_pivots)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("array<double>")
    def to_pivots(v: pd.Series) -> pd.Series:
        return pd.Series(list(_distances(np.stack(v.to_numpy()), shared.value)) if len(v) else [])

    placed = rows.withColumn("p", to_pivots("v"))
    placed = placed.withColumn("d", F.array_min("p")).withColumn("near", F.array_position("p", F.col("d")))
    ranged = in_ranges(placed, ["near", "d", "id"], block).drop("_place").withColumnRenamed("_part", "b")
    each = [f(F.col("p")[i]).alias(f"{name}{i}") for i in range(len(pivots)) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = [(r["b"], [r[f"lo{i}"] for i in range(len(pivots))], [r[f"hi{i}"] for i in range(len(pivots))]) for r in ranged.groupBy("b").agg(*each).collect()]  # one row a block
    return ranged.select("id", "v", "b"), sorted(boxes), pivots


def meet_blocks(asking: DataFrame, blocks: DataFrame, k: int, id_type: str, per_copy: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """(query, neighbour, distance): the k nearest of each block for the queries (id, v, b) sent to it; and the copies of
    blocks that are sent (b, copies). Only blocks that are asked for move, once for every ``per_copy`` queries; a task
    holds a block while its queries pass by."""
    copies = written(asking.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / per_copy).cast("int").alias("copies")), "copies")
    left = asking.join(sized_broadcast(copies), "b").select("b", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("c"), F.lit(1).alias("side"), "id", "v")
    right = blocks.join(sized_broadcast(copies), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("c"), F.lit(0).alias("side"), "id", "v")
    tasks = min(20_000, max(int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions")), copies.agg(F.sum("copies")).first()[0] or 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held = None, [], None
        for batch in batches:
            b, c, side, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(c) != 0) | (np.diff(side) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(b)]):
                v = _matrix(batch.column(4).slice(s, e - s))
                if side[s] == 0:
                    if (b[s], c[s]) != key:
                        key, parts, held = (b[s], c[s]), [], None
                    parts.append((ids[s:e], v))
                elif (b[s], c[s]) == key:
                    if held is None:
                        held = Nearest(*(np.concatenate(x) for x in zip(*parts)), k)
                    row, near, d = held.of(ids[s:e], v)
                    kinds = (batch.schema.field("id").type, batch.schema.field("id").type, pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids[s:e][row], near, d), kinds)], names=["query", "neighbour", "distance"])

    both = left.unionByName(right).repartition(tasks, "b", "c").sortWithinPartitions("b", "c", "side")
    return both.mapInArrow(run, f"query {id_type}, neighbour {id_type}, distance double"), copies


def nearest_vectors(df: DataFrame, key: str, vector: str, k: int, block: int = 4096, queries: DataFrame | None = None, n_pivots: int = 8) -> DataFrame:
    """key, rank, neighbour, distance: the ``k`` nearest other vectors by Euclidean distance (TSR3, TSR4).

    Vectors stand in blocks by their nearest pivot and distance to it. A query first meets the block of its own place, which
    bounds its k-th distance; it then goes only to blocks that the triangle inequality on any pivot does not rule out. A
    block is sent once, however many queries ask for it (once for each million of them), and not at all if none does.
    Memory is one block and one batch of queries. Ties go to the smaller key.
    """
    sized = lambda t: t.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    id_type = df.schema[key].dataType.simpleString()
    rows = written(sized(df), "vectors")
    none = df.select(F.col(key), F.lit(0).alias("rank"), F.col(key).alias("neighbour"), F.lit(0.0).alias("distance")).limit(0)
    if rows.isEmpty():
        return none
    blocks, boxes, pivots = blocks_by_pivots(rows, block, n_pivots)
    asked = written(sized(queries), "asked") if queries is not None else rows
    names, low, high = (np.array(x) for x in zip(*boxes))
    shared = df.sparkSession.sparkContext.broadcast((pivots, names, low, high))

    def gaps(v: pd.Series) -> np.ndarray:
        """How far the queries are from each block at least."""
        pivots, _, low, high = shared.value
        d = _distances(np.stack(v.to_numpy()), pivots)
        out = np.zeros((len(v), len(low)))
        for i in range(len(pivots)):
            np.maximum(out, low[None, :, i] - d[:, i, None], out=out)
            np.maximum(out, d[:, i, None] - high[None, :, i], out=out)
        return out

    @F.pandas_udf("int")
    def own(v: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([shared.value[1][gaps(v[s : s + 1024]).argmin(1)] for s in range(0, len(v), 1024)]) if len(v) else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def others(v: pd.Series, bound: pd.Series, own: pd.Series) -> pd.Series:
        names, out = shared.value[1], []
        for s in range(0, len(v), 1024):
            reach = bound[s : s + 1024].fillna(np.inf).to_numpy() * (1 + 1e-9) + 1e-6
            for may, o in zip(gaps(v[s : s + 1024]) <= reach[:, None], own[s : s + 1024]):
                out.append([int(b) for b in names[may] if b != o])
        return pd.Series(out)

    asked = asked.withColumn("b", own("v"))
    near = written(meet_blocks(asked, blocks, k, id_type)[0], "near")
    bound = near.groupBy("query").agg(F.max("distance").alias("bound"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("query").alias("id"), "bound")
    rest = written(asked.join(bound, "id", "left").withColumn("b", F.explode(others("v", "bound", "b"))).select("id", "v", "b"), "sent")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    found = near.unionByName(meet_blocks(rest, blocks, k, id_type)[0]).withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select(F.col("query").alias(key), F.col("rank").cast("int").alias("rank"), "neighbour", "distance")

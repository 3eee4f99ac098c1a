"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule, piecewise linear over training time 0 to 1. Its integral is the source's weight in
the whole mix; targets share a word budget by these weights, none above ``max_epochs`` times what the source has. A
source's documents follow each other in hash order, epoch after epoch, until its target is met to the nearest whole
document: texts are never cut. A document copy that starts at word ``o`` of its source's target T is read when the source's integrated schedule reaches o / T: inverting
that gives the training position, and the mix is range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import dense_index
from .common import free_name, running_total, small, written

Schedule = Sequence[tuple[float, float]]


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def checked(schedule: Schedule) -> Schedule:
    times = [t for t, _ in schedule]
    if len(schedule) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])):
        raise ValueError("a schedule's times rise from 0 to 1")
    if min(w for _, w in schedule) < 0 or integral(schedule) <= 0:
        raise ValueError("a schedule's weights are not negative and not all zero")
    return schedule


def share_out(sizes: Sequence[int], weights: Sequence[float], budget: float, max_epochs: float) -> list[float]:
    """Targets that share ``budget`` by weight; what exceeds max_epochs times a size is shared again by the others.

    For lists; ``_level`` does the same over a table.
    """
    target = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if budget * weights[i] / total > max_epochs * sizes[i]]
        if not over:
            for i in open_:
                target[i] = budget * weights[i] / total
            break
        for i in over:
            target[i] = max_epochs * sizes[i]
            budget -= target[i]
        budget = max(budget, 0.0)
        closed = set(over)
        open_ = [i for i in open_ if i not in closed]
    return target


@dataclass(frozen=True)
class Mix:
    """``schedules`` maps ranks 0, 1, 2 ... of the sources, by code point and null last, to weights; they repeat."""

    schedules: Sequence[Schedule]
    budget_share: float = 1.5
    max_epochs: float = 2.0


#: Weights 3, 1 and 2 over the whole run: the first kind of source fades, the second grows, the third is level.
CURRICULUM = Mix(schedules=[checked([(0.0, 4.5), (1.0, 1.5)]), checked([(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]), checked([(0.0, 2.0), (1.0, 2.0)])])


def words_in(text: Column) -> Column:
    """Number of words, [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _level(sources: DataFrame, weights: Sequence[float], budget_share: float, max_epochs: float) -> float:
    """Words per unit of weight, so that targets min(max_epochs * source_size, level * weight) share the budget.

    Each round counts the sources that are full at the level so far, one row a kind of schedule; the level only rises.
    """
    level = 0.0
    while True:
        full = F.col("source_size") * F.lit(float(max_epochs)) < F.lit(level) * F.col("weight")
        sums = sources.groupBy("kind").agg(F.sum("source_size").alias("size"), F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("full"), F.count_if(~full).alias("open"))
        rows = sorted(sums.collect(), key=lambda r: r["kind"])
        open_weight = sum(r["open"] * weights[r["kind"]] for r in rows)
        if not open_weight:
            return float("inf")
        risen = max(budget_share * sum(r["size"] for r in rows) - max_epochs * sum(r["full"] for r in rows), 0.0) / open_weight
        if risen <= level:
            return level
        level = risen


def _plan(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row a source: source, source_size, target, demand (whole words), weight and the schedule's segments."""
    weights, segments = [integral(s) for s in mix.schedules], []
    for schedule, weight in zip(mix.schedules, weights):
        area, parts = 0.0, []
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            parts.append(F.struct(*[F.lit(float(x)).alias(n) for n, x in (("f", area / weight), ("t", t0), ("dt", t1 - t0), ("w0", w0), ("w1", w1))]))
            area += (t1 - t0) * (w0 + w1) / 2
        segments.append(F.array(*parts))
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = written(sums.withColumn("unnamed", F.col("source").isNull().cast("int")).withColumn("name", F.coalesce("source", F.lit(""))), "sources")
    kind = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    ranked = dense_index(sums, ["unnamed", "name"], "rank").select("source", "source_size", kind.alias("kind"))
    sources = written(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)), "ranked")
    level = _level(sources, weights, mix.budget_share, mix.max_epochs)
    most = F.col("source_size") * F.lit(float(mix.max_epochs))
    plan = sources.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))
    plan = plan.withColumn("demand", F.least(F.rint("target"), F.floor(most)).cast("long"))
    plan = plan.select("source", "source_size", "target", "demand", "weight", F.element_at(F.array(*segments), F.col("kind") + 1).alias("segments"))
    return small(plan)


def _position(offset: Column, demand: Column, weight: Column, segments: Column) -> Column:
    """Training time at which the source's integrated schedule reaches offset / demand."""
    share = offset.cast("double") / demand
    seg = F.element_at(F.filter(segments, lambda s: s["f"] <= share), -1)
    area = (share - seg["f"]) * weight / seg["dt"]
    rise = seg["w1"] - seg["w0"]
    root = F.sqrt(F.greatest(seg["w0"] * seg["w0"] + rise * area * 2, F.lit(0.0)))
    inside = F.when(seg["w0"] + root > 0, area * 2 / (seg["w0"] + root)).otherwise(F.lit(0.0))
    return F.least(seg["t"] + seg["dt"] * inside, F.lit(1.0))


def mix_sizes(sized: DataFrame, mix: Mix, order: Sequence[str] = ("doc_id", "key", "size"), ties: Sequence[str] = ()) -> DataFrame:
    """``sized`` (id columns, source, size, rows) with source_size, target, first_word (of its source), demand, ``full``
    (copies that every row gets) and ``more`` (how many of the rows get one copy more).

    ``sized`` is one row for ``rows`` equal ones, which follow each other. The last copy of a source is read if at least
    half of it is still wanted, and if no more than ``max_epochs`` times the source's words are read with it. Rows are
    put in order by a hash of the ``order`` columns, so reruns agree. Sources whose name is null are one source. A
    source without words has target 0. An empty table stays empty.
    """
    volume = free_name(sized, "_volume")
    sized = sized.withColumn(volume, F.col("size") * F.col("rows"))
    plan = _plan(sized.withColumn("size", F.col(volume)), mix)
    before = running_total(sized, ["source"], list(order), volume, "first_word", ties=ties)
    joined = before.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("demand") / F.col("source_size"))).otherwise(0).cast("long")
    joined = joined.select("r.*", "p.source_size", "p.target", "p.demand", "p.weight", "p.segments", full.alias("full")).drop(volume)
    wanted = (F.col("demand") - F.col("full") * F.col("source_size") - F.col("first_word")) * 2 - F.col("size")
    room = F.floor(F.col("source_size") * F.lit(float(mix.max_epochs))) - F.col("full") * F.col("source_size") - F.col("first_word") - F.col("size")
    fitting = F.least("rows", F.expr("wanted_ div (2 * size)") + 1, F.expr("room_ div size") + 1)
    more = F.when((F.col("size") > 0) & (F.col("wanted_") >= 0) & (F.col("room_") >= 0), fitting).otherwise(0)
    return joined.withColumns({"wanted_": wanted, "room_": room}).withColumn("more", more.cast("long")).drop("wanted_", "room_")


def each_row(mixed: DataFrame) -> DataFrame:
    """One row per row again: first_word of its own, and ``taken``, a whole number of copies."""
    rows = mixed.withColumn("turn_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    taken = (F.col("full") + F.when(F.col("turn_") < F.col("more"), 1).otherwise(0)) * F.col("size")
    return rows.withColumns({"first_word": F.col("first_word") + F.col("turn_") * F.col("size"), "taken": taken.cast("long")}).drop("turn_", "rows", "full", "more")


def copies(rows: DataFrame) -> DataFrame:
    """One row per copy that the mix reads, always whole: epoch, position."""
    epoch = F.explode(F.sequence(F.lit(0), F.expr("taken div size - 1").cast("int"))).alias("epoch")
    rows = rows.filter(F.col("taken") > 0).select("*", epoch)
    start = F.col("epoch") * F.col("source_size") + F.col("first_word")
    return rows.withColumn("position", _position(start, F.col("demand"), F.col("weight"), F.col("segments")))


def mix_documents(docs: DataFrame, mix: Mix = CURRICULUM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source), range-sorted by ``position``, that of its first copy.

    Columns: doc_id, size, source_size, target, taken, source, position (null where the mix takes nothing).
    Documents without words take nothing. ``taken`` is what ``mixed_corpus`` reads of the row.
    """
    named = docs.select("doc_id", F.md5("text").alias("key"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    sized = written(named.groupBy("doc_id", "key", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    mixed = each_row(mix_sizes(sized, mix))
    at = F.when(F.col("taken") > 0, _position(F.col("first_word"), F.col("demand"), F.col("weight"), F.col("segments")))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", "source", at.alias("position"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), F.col("doc_id"))


def mixed_corpus(docs: DataFrame, mix: Mix = CURRICULUM) -> DataFrame:
    """The rows of ``docs`` as often as the mix reads them, in order of position, columns as in ``docs``.

    Texts stay whole: the copy at which a source meets its target is read or left out. Positions are found on narrow
    rows; texts move once to meet them and once into order. Rows equal in every column are one row with a count.
    ``docs`` is read more than once; hand in a written table.
    """
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"], F.lit(1)))
    same = F.md5(F.concat(F.coalesce(F.md5("text"), F.lit("")), others))
    named = docs.select(same.alias("same"), "doc_id", F.md5("text").alias("key"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    sized = written(named.groupBy("same", "doc_id", "key", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    read = copies(each_row(mix_sizes(sized, mix, ties=["same"])))
    places = written(read.select("same", "position"), "places")
    rows = docs.select(same.alias("same"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if sized.filter("rows > 1").take(1):
        rows = rows.groupBy("same").agg(F.first("row").alias("row"))
    read = rows.join(places, "same").select("row", "position", F.col("row.doc_id").alias("doc_id"))
    ordered = read.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return ordered.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

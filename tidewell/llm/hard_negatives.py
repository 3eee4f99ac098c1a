"""Hard negatives by Fagin's threshold algorithm.

Vectors are sorted by label and cut into blocks; a block holds, for every dimension, its rows in the order of that
component. An anchor reads these lists from the end its own component's sign asks for, all to the same depth, scores
every row it meets for the first time by its integer inner product, and stops once the threshold (the product with the
last components read) lies strictly below what each of its windows still takes. Anchors stand in turns: a task holds
one turn with what its anchors have found so far, and blocks pass by one after the other, so a later block is read
only as deep as it may still change a window. First the anchors meet the blocks of their own label (positives), then
those of other labels, with one window of scores for each positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Bytes that a block may take in a task, its lists included, and its rows at most and at least; anchors in a turn;
#: blocks that meet a turn in one go, at most; tasks of a meeting, at most.
BLOCK_BYTES = 96_000_000
BLOCK_ROWS = 65_536
LEAST_ROWS = 4_096
TURN = 8_192
GROUP = 16
TASKS = 20_000
#: Depth of the first sorted access; every further one reads as deep again.
DEPTH = 32
#: Whole numbers up to this are exact in double precision, sums of products included.
EXACT = 2.0**52
LONG = (-(1 << 63), (1 << 63) - 1)
PACKED = "part long, first_label long, last_label long, ids binary, labels binary, flat binary"


def labelled_vectors(table: DataFrame, label: F.Column, vector: str = "embedding", id_column: str = "vec_id", scale: float = 256.0) -> DataFrame:
    """vec_id, label, v (array of double: floor(scale * x), whole numbers). Rows with a null id, label or vector, or any
    null or non-finite component, before or after scaling, take no part."""
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double") * F.lit(float(scale)))
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)
    # from 2**52 on every double is whole; floor() would leave the range of long
    whole = F.transform("x", lambda c: F.when(F.abs(c) < EXACT, F.floor(F.when(F.abs(c) < EXACT, c).otherwise(0.0)).cast("double")).otherwise(c))
    return rows.select("vec_id", "label", whole.alias("v"))


def _packed(rows: DataFrame, width: int, kind: str, at_most: int) -> DataFrame:
    """Runs of at most so many rows of a partition as bytes, with their smallest and largest label; rows come by label."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            ids, labels, flat = (np.concatenate(x) for x in zip(*held))
            values = (part, int(labels.min()), int(labels.max()), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), flat.astype(kind).tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["part", "first_label", "last_label", "ids", "labels", "flat"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, min(batch.num_rows - at, at_most - n))
                held.append((some.column(0).to_numpy(), some.column(1).to_numpy(), _padded(some.column(2), width)))
                at, n = at + some.num_rows, n + some.num_rows
                if n == at_most:
                    yield row()
                    part, held, n = part + 1, [], 0
        if held:
            yield row()

    return rows.select("vec_id", "label", "v").mapInArrow(pack, PACKED)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, shorter ones padded by zeros."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    size = np.diff(at)
    out[np.repeat(np.arange(len(column)), size), np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)] = flat[at[0] : at[-1]]
    return out


@dataclass
class Rows:
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    @classmethod
    def unpacked(cls, row, width: int, kind: str, wide: bool) -> Rows:
        ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        v = np.frombuffer(row["flat"], kind).reshape(len(ids), width).astype(float)
        return cls(ids, labels, np.array([[int(x) for x in r] for r in v], object).reshape(v.shape) if wide else v)


class Lists:
    """Rows with the order of every component, smallest first."""

    def __init__(self, rows: Rows) -> None:
        self.rows = rows
        self.order = np.stack([np.argsort(c, kind="stable").astype(np.int32) for c in rows.v.T]) if len(rows.v.T) else np.empty((0, len(rows.ids)), np.int32)

    def new_rows(self, q: np.ndarray, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, object]]:
        """Rows met for the first time, and the threshold: no row that is still to come has a larger product with ``q``.
        It is None with the last rows."""
        n, up, down = len(self.rows.ids), np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen, at, left = np.zeros(n, bool), 0, n
        while left and at + depth < n and len(up) + len(down):
            end = at + depth
            met = np.concatenate([self.order[up, n - end : n - at].ravel(), self.order[down, at:end].ravel()])
            new = np.unique(met[~seen[met]])
            seen[new] = True
            left -= len(new)
            last = np.concatenate([self.rows.v[self.order[up, n - end], up] * q[up], self.rows.v[self.order[down, end - 1], down] * q[down]])
            yield new, last.sum() if left else None
            at, depth = end, end
        if left:
            yield np.flatnonzero(~seen), None


@dataclass
class Windows:
    """What one anchor has found: for each of its windows of scores, the ``k`` best with their ids, best first."""

    low: list
    high: list
    k: int

    def __post_init__(self) -> None:
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.low]

    def takes(self) -> float | int:
        """A row scoring strictly less changes no window."""
        need = [b[-1][0] if len(b) == self.k else low for b, low, high in zip(self.best, self.low, self.high) if low <= high]
        return min(need, default=float("inf"))

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        for b, (low, high) in enumerate(zip(self.low, self.high)):
            held = self.best[b]
            at = np.flatnonzero((score >= (held[-1][0] if len(held) == self.k else low)) & (score <= high))
            if len(at) > 4 * self.k and score.dtype != object:  # all that may be among the first k, ties included
                s = score[at]
                at = at[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]]
            if len(at):
                self.best[b] = sorted([*held, *((int(s), int(i)) for s, i in zip(score[at], ids[at]))], key=lambda x: (-x[0], x[1]))[: self.k]


def search(found: Windows, q: np.ndarray, own_id: int, own_label: int | None, lists: Lists) -> int:
    """Brings ``found`` up to date with a block; rows of the anchor's id, and of ``own_label``, do not count. Returns how
    many rows were scored."""
    scored = 0
    for new, threshold in lists.new_rows(q):
        rows = lists.rows
        new = new[(rows.ids[new] != own_id) & ((rows.labels[new] != own_label) if own_label is not None else True)]
        found.add(rows.v[new] @ q, rows.ids[new])
        scored += len(new)
        if threshold is None or threshold < found.takes():
            break
    return scored


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), high * score // 100


FOUND = "turn long, anchor int, window int, anchor_id long, positive_id long, positive_score long, vec_id long, score long, exact string"


def _meet(blocks: DataFrame, turns: DataFrame, spans: DataFrame, n_tasks: int, k: int, shape: tuple[int, str, bool], low: int, high: int) -> DataFrame:
    """What the anchors of every turn find in the blocks it goes to. ``turns``: turn, first_label, last_label, ids, labels,
    flat, positives (null: look for positives). ``spans``: one row with the list of all blocks' part, first_label, last_label
    and grp. Blocks of which no row can count are not sent."""
    width, kind, wide = shape

    def meets(block, turn):
        overlap = (block["first_label"] <= turn["last_label"]) & (block["last_label"] >= turn["first_label"])
        one = overlap & (block["first_label"] == block["last_label"]) & (turn["first_label"] == turn["last_label"])
        return F.when(turn["positives"].isNull(), overlap).otherwise(~one)

    narrow = turns.select("turn", "first_label", "last_label", F.when(F.col("positives").isNotNull(), "").alias("positives"))
    sent = blocks.alias("b").join(F.broadcast(narrow.alias("t")), meets(*({c: F.col(f"{x}.{c}") for c in ("first_label", "last_label", "positives") if x == "t" or c != "positives"} for x in "bt")))
    left = sent.select("t.turn", "b.grp", F.lit(1).alias("kind"), "b.part", "b.ids", "b.labels", "b.flat", F.lit(None).cast("string").alias("positives"))
    groups = F.array_distinct(F.transform(F.filter("spans", lambda b: meets(b, {c: F.col(c) for c in ("first_label", "last_label", "positives")})), lambda b: b["grp"]))
    right = turns.crossJoin(F.broadcast(spans)).withColumn("grp", F.explode(groups))
    right = right.select("turn", "grp", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("part"), "ids", "labels", "flat", "positives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, found, positives = None, None, [], []
        clipped = lambda x: min(max(x, LONG[0]), LONG[1])

        def out() -> pa.RecordBatch:
            rows = []
            for a, f in enumerate(found):
                for b, best in enumerate(f.best):
                    score, of = positives[a][b] if positives[a] else (0, 0)
                    rows += [(key, a, b, int(anchors.ids[a]), of, clipped(score), i, clipped(s), _key(s) if wide else None) for s, i in best]
            kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 9, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

        for batch in batches:
            for r in (x for s in range(batch.num_rows) for x in batch.slice(s, 1).to_pylist()):
                if r["kind"] == 0:
                    if key is not None:
                        yield out()
                    key, seeking, anchors = r["turn"], r["positives"] is None, Rows.unpacked(r, width, kind, wide)
                    positives = [[] for _ in anchors.ids]
                    for a, pairs in _parsed(r["positives"]):
                        positives[a] = pairs
                    windows = [[(-(1 << 400), 1 << 400)] if seeking else [window_of(s, low, high) for s, _ in p] for p in positives]
                    found = [Windows([x[0] for x in w], [x[1] for x in w], k) for w in windows]
                    continue
                rows = Rows.unpacked(r, width, kind, wide)
                cuts = np.flatnonzero(np.diff(rows.labels)) + 1  # rows come by label: lists for those of each
                of = {int(rows.labels[s]): slice(s, e) for s, e in zip([0, *cuts], [*cuts, len(rows.ids)])}
                lists = {} if seeking else {None: Lists(rows)}
                for a, label in enumerate(anchors.labels.tolist()):
                    if seeking and label in of:
                        if label not in lists:
                            lists[label] = Lists(Rows(rows.ids[of[label]], rows.labels[of[label]], rows.v[of[label]]))
                        search(found[a], anchors.v[a], int(anchors.ids[a]), None, lists[label])
                    elif not seeking and found[a].low:
                        search(found[a], anchors.v[a], int(anchors.ids[a]), label, lists[None])
        if key is not None:
            yield out()

    dealt = left.unionByName(right).repartition(n_tasks, "turn", "grp").sortWithinPartitions("turn", "grp", "kind", "part")
    return dealt.mapInArrow(run, FOUND)


def _parsed(text: str | None) -> list[tuple[int, list[tuple[int, int]]]]:
    """anchor:score=id,score=id;anchor:... as numbers; a text, since scores may leave the range of long."""
    split = [x.partition(":") for x in (text or "").split(";") if x]
    return [(int(a), [tuple(map(int, x.split("="))) for x in pairs.split(",")]) for a, _, pairs in split]


def _key(score: int) -> str:
    """A score as a text that sorts as it does, and from which it can be read again: sign, number of digits, digits (below
    zero each taken from nine)."""
    digits = str(abs(score))
    return f"1{len(digits):04d}{digits}" if score >= 0 else f"0{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _score(exact: str | None, score: int) -> int:
    if exact is None:
        return score
    return int(exact[5:]) if exact[0] == "1" else -int(exact[5:].translate(str.maketrans("0123456789", "9876543210")))


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("turn", "anchor", "window").orderBy(F.desc("score"), F.desc_nulls_last("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, n_positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, v as ``labelled_vectors`` gives. Anchors are the distinct rows whose id ``every`` divides.
    An anchor's positives are its ``n_positives`` best other rows of the same label (all, if fewer), its negatives for a
    positive the ``k`` best rows of other labels whose score is from ``low`` to ``high`` percent of the positive's. Rows
    of the anchor's own id never count; other repeated rows count as often as they stand. Ties go to the smaller id.
    Shorter vectors count as padded by zeros. Scores are exact at every size; one beyond long is given as long's end.
    No row, or none of another label, gives no rows.
    """
    spark = rows.sparkSession
    kind_out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(rows.select("vec_id", "label", "v"), "labelled")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    size = rows.agg(F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("n"), F.max(square).alias("square"), F.max(most).alias("most")).first()
    if not size["n"]:
        return spark.createDataFrame([], kind_out)
    width, kind = size["width"], "<i2" if size["most"] < 1 << 15 else "<i4" if size["most"] < 1 << 31 else "<f8"
    shape = (width, kind, not size["square"] < EXACT)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at_most = max(1, min(BLOCK_ROWS, max(LEAST_ROWS, -(-size["n"] // tasks)), BLOCK_BYTES // (12 * max(1, width))))
    n_blocks = -(-size["n"] // at_most)
    salt = F.xxhash64(F.monotonically_increasing_id())  # copies of a row part, too; the table's files give it anew alike
    spread = rows.withColumn("salt", salt).repartitionByRange(n_blocks, "label", "salt").sortWithinPartitions("label", "salt")
    blocks = written(_packed(spread, width, kind, at_most), "blocks")
    known = blocks.select("part", "first_label", "last_label").orderBy("part").collect()  # three numbers a block
    together = min(GROUP, max(1, len(known) // tasks))
    listed = [(r["part"], r["first_label"], r["last_label"], i // together) for i, r in enumerate(known)]
    numbers = "part long, first_label long, last_label long, grp long"
    blocks = blocks.join(F.broadcast(spark.createDataFrame([(r[0], r[3]) for r in listed], "part long, grp long")), "part")
    spans = spark.createDataFrame([(listed,)], f"spans array<struct<{', '.join(x.replace(' ', ':') for x in numbers.split(', '))}>>")
    anchors = written(rows.filter(F.col("vec_id") % every == 0).distinct(), "anchors")
    n_turns = max(1, -(-anchors.count() // TURN))
    turns = written(_packed(anchors.repartitionByRange(n_turns, "label", "vec_id").sortWithinPartitions("label", "vec_id"), width, kind, TURN), "turns").withColumnRenamed("part", "turn")
    n_tasks = min(TASKS, 2 * n_turns * -(-len(known) // together))

    met = _meet(blocks, turns.withColumn("positives", F.lit(None).cast("string")), spans, n_tasks, n_positives, shape, low, high)
    first = _first(met, n_positives).select("turn", "anchor", "rank", "vec_id", "score", "exact")
    exact = F.udf(lambda e, s: str(_score(e, s)), "string")(F.col("exact"), F.col("score")) if shape[2] else F.col("score").cast("string")
    pairs = F.array_sort(F.collect_list(F.struct("rank", F.concat(exact, F.lit("="), F.col("vec_id").cast("string")).alias("p"))))
    per_anchor = first.groupBy("turn", "anchor").agg(F.array_join(F.transform(pairs, lambda x: x["p"]), ",").alias("p"))
    per_turn = per_anchor.groupBy("turn").agg(F.array_join(F.collect_list(F.concat(F.col("anchor").cast("string"), F.lit(":"), F.col("p"))), ";").alias("positives"))
    turns = written(turns.join(per_turn, "turn"), "turns")
    found = _first(_meet(blocks, turns, spans, n_tasks, k, shape, low, high), k)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

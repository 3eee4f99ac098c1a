"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are put in descending order of length and cut into blocks; queries stand in batches, one packed row each. Every
batch meets the longest vectors first, which gives each query a k-th score to beat. It then goes only to the blocks
whose longest vector may reach that for one of its queries (Cauchy-Schwarz). Blocks and batches are rows of one table,
dealt out by block; nothing is broadcast but the rotation and one length a block. Within a block, the leading coordinates of a
rotation into singular directions are multiplied first; where that partial sum plus the product of the residual lengths
stays below the k-th score, the pair is dropped. What is left is scored exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Bytes of one block of vectors; vectors multiplied at a time, and in one packed row; queries in a batch, on average.
BLOCK_BYTES = 64_000_000
STEP = 4096
QUERIES = 512
#: Batches that meet one copy of a block, and one copy of the longest vectors.
BATCHES = 1024
FIRST_BATCHES = 4
#: Whole numbers up to this are exact in double precision, sums of products included.
EXACT = 2.0**52
LONG = (-(1 << 63), (1 << 63) - 1)


def integer_vectors(table: DataFrame, id_column: str, vector: str, scale: float) -> DataFrame:
    """vec_id, v (array of double: floor(scale * x), a whole number), norm. Null ids, null or empty vectors and vectors
    that hold null or non-finite components, before or after scaling, take no part."""
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double") * F.lit(float(scale)))
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), x.alias("x"))
    good = F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # from 2**52 on every double is whole; floor() would leave the range of long
    whole = F.transform("x", lambda c: F.when(F.abs(c) < EXACT, F.floor(F.when(F.abs(c) < EXACT, c).otherwise(0.0)).cast("double")).otherwise(c))
    rows = rows.filter(F.coalesce(good, F.lit(False))).select("vec_id", whole.alias("v"))
    most = F.array_max(F.transform("v", F.abs))  # scaled by the largest component, squares stay finite
    unit = F.aggregate("v", F.lit(0.0), lambda a, c: a + F.pow(F.try_divide(c, most), F.lit(2.0)))
    return rows.withColumn("norm", F.coalesce(F.sqrt(unit) * most, F.lit(0.0)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, shorter ones padded by zeros."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    size = np.diff(at)
    rows = np.repeat(np.arange(len(column)), size)
    out[rows, np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)] = flat[at[0] : at[-1]]
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular directions of all vectors, each at unit length, strongest first; width**2 sums reach the driver."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width)
            m /= np.maximum(np.abs(m).max(1, keepdims=True), 1.0)
            m /= np.maximum(np.sqrt((m**2).sum(1, keepdims=True)), 1e-300)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "x"])

    total = np.zeros(width * width)
    for r in vectors.select("v").mapInArrow(gram, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        total[r["at"]] = r["x"]
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1].copy()


def exact_scores(q: np.ndarray, v: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Inner products of paired rows of whole numbers, exact; ``bound`` is at least the product of their lengths. Long
    where all fit in double precision, Python integers otherwise."""
    small = bound < EXACT
    if small.all():
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    out = np.empty(len(q), object)
    out[small] = np.einsum("ij,ij->i", q[small], v[small]).astype(np.int64)
    for i in np.flatnonzero(~small):
        out[i] = sum(int(a) * int(b) for a, b in zip(q[i], v[i]))
    return out


def _below(scores: np.ndarray) -> np.ndarray:
    """The scores as doubles, rounded down."""
    with np.errstate(over="ignore"):
        try:
            x = scores.astype(float)
        except OverflowError:
            x = np.array([float(s) if abs(s) < 1 << 1000 else -np.inf for s in scores])
    return np.nextafter(x, -np.inf)


class Best:
    """The k best (score, smaller id) of each query so far, and a score below the k-th: what is lower cannot enter."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.n, self.floor = k, n, floor.copy()
        self.q, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.q, self.id, self.score = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.score, score)))
        if self.score.dtype == object:
            order = np.array(sorted(range(len(self.q)), key=lambda i: (self.q[i], -self.score[i], self.id[i])), np.int64)
        else:
            order = np.lexsort((self.id, -self.score, self.q))
        q = self.q[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1)) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = order[rank < self.k]
        self.q, self.id, self.score = self.q[keep], self.id[keep], self.score[keep]
        kth = np.flatnonzero(np.bincount(self.q, minlength=self.n) >= self.k)
        last = np.searchsorted(self.q, kth, "right") - 1
        self.floor[kth] = np.maximum(self.floor[kth], _below(self.score[last]))


class Rotated:
    """Vectors with their lengths, leading rotated coordinates and residual lengths."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, basis: np.ndarray, lead: int) -> None:
        self.ids, self.v = ids, v
        most = np.maximum(np.abs(v).max(1), 1.0) if len(v) else np.ones(0)
        unit = v / most[:, None]
        length = np.sqrt((unit**2).sum(1))
        rot = unit @ basis[:, :lead]
        rest = np.sqrt(np.maximum(length**2 - (rot**2).sum(1), 0))
        self.norm, self.rot, self.rest = length * most, rot * most[:, None], rest * most

    def __getitem__(self, part) -> Rotated:
        out = object.__new__(Rotated)
        for name in ("ids", "v", "norm", "rot", "rest"):
            setattr(out, name, getattr(self, name)[part])
        return out


def search_block(best: Best, q: Rotated, block: Rotated) -> None:
    """Meets vectors, longest first, with all queries of a batch."""
    for s in range(0, len(block.ids), STEP):
        b = block[s : s + STEP]
        with np.errstate(over="ignore", invalid="ignore"):
            reach = q.norm * b.norm.max() * (1 + 1e-9)
            open_ = np.flatnonzero(~(reach < best.floor))
            if not len(open_):
                return  # what follows is shorter still
            o = q[open_]
            most = o.norm[:, None] * b.norm[None, :]
            bound = o.rot @ b.rot.T + o.rest[:, None] * b.rest[None, :]
            row, col = np.nonzero(~(bound + 1e-6 * (1 + most) < best.floor[open_, None]))
        row = open_[row]
        other = q.ids[row] != b.ids[col]
        row, col = row[other], col[other]
        for at in range(0, len(row), 1 << 16):
            r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
            with np.errstate(over="ignore"):
                score = exact_scores(q.v[r], b.v[c], q.norm[r] * b.norm[c] * (1 + 1e-9))
            good = score >= best.floor[r]
            best.add(r[good], b.ids[c[good]], score[good])


def _key(score: int) -> str:
    """A text that sorts as the score does: its sign and number of digits first, each digit taken from 9 below zero."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


FOUND = "batch long, query_id long, query_no long, vec_id long, score long, sorts string"
PACKED = "{0} long, piece int, longest double, ids binary, sizes binary, flat binary"


def _packed(rows: DataFrame, name: str, at_most: int | None) -> DataFrame:
    """(name, piece, longest, ids, sizes, flat): runs of rows of equal ``name`` as bytes, ``at_most`` rows each (None: all)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece, held, n = None, 0, [], 0

        def row() -> pa.RecordBatch:
            longest, *packed = zip(*held)
            values = ([key], [piece], [max(longest)], *([b"".join(x)] for x in packed))
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=[name, "piece", "longest", "ids", "sizes", "flat"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
            for a, z in zip(cuts, cuts[1:]):
                if int(of[a]) != key:
                    if held:
                        yield row()
                    key, piece, held, n = int(of[a]), 0, [], 0
                while a < z:
                    m = z - a if at_most is None else min(z - a, at_most - n)
                    at = batch.column(2).offsets.to_numpy()[a : a + m + 1]
                    flat = batch.column(2).values.to_numpy()[at[0] : at[-1]]
                    held.append((float(batch.column(3).to_numpy()[a : a + m].max()), batch.column(1).to_numpy()[a : a + m].astype("<i8").tobytes(), np.diff(at).astype("<i8").tobytes(), flat.astype("<f8").tobytes()))
                    a, n = a + m, n + m
                    if n == at_most:
                        yield row()
                        piece, held, n = piece + 1, [], 0
        if held:
            yield row()

    return rows.select(name, "vec_id", "v", "norm").mapInArrow(pack, PACKED.format(name))


def _unpacked(parts: list[tuple[bytes, bytes, bytes]], basis: np.ndarray, lead: int) -> Rotated:
    ids, sizes, flat = (np.concatenate([np.frombuffer(p[i], t) for p in parts]) for i, t in ((0, "<i8"), (1, "<i8"), (2, "<f8")))
    v = np.zeros((len(ids), len(basis)))
    v[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return Rotated(ids, v, basis, lead)


def _sent(batches: DataFrame, start: DataFrame | None, shared, blocks: list[int], norms: np.ndarray, k: int, per_copy: int) -> DataFrame:
    """The batches for each block that may hold better than what ``start`` has: batch, block, turn, floors."""
    low = np.iinfo(np.int64).min
    if start is not None:
        kth = start.groupBy("batch", "query_no").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).filter((F.col("n") >= k) & (F.col("low") > low))
        batches = batches.join(kth.groupBy("batch").agg(F.collect_list(F.struct("query_no", "low")).alias("reached")), "batch", "left")
    else:
        batches = batches.withColumn("reached", F.expr("cast(null as array<struct<query_no:bigint,low:bigint>>)"))

    def plan(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, lead = shared.value
        for batch in arrow:
            floors, meets = [], []
            for r in batch.to_pylist():
                q = _unpacked([(r["ids"], r["sizes"], r["flat"])], basis, lead)
                floor = np.full(len(q.ids), -np.inf)
                for x in r["reached"] or ():
                    floor[x["query_no"]] = np.nextafter(float(x["low"]), -np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(floor <= 0, -np.inf, floor / (q.norm * (1 + 1e-9))).min()
                floors.append(floor.astype("<f8").tobytes())
                meets.append(blocks[: int(np.searchsorted(-norms, -least, "right"))])
            kept = [batch.column(c) for c in ("batch", "ids", "sizes", "flat")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(floors, pa.binary()), pa.array(meets, pa.list_(pa.int64()))], names=["batch", "ids", "sizes", "flat", "floors", "meets"])

    planned = batches.select("batch", "ids", "sizes", "flat", "reached").mapInArrow(plan, "batch long, ids binary, sizes binary, flat binary, floors binary, meets array<long>")
    return planned.withColumn("block", F.explode("meets")).withColumn("turn", F.floor(F.col("batch") / per_copy).cast("int")).drop("meets")


def _meet(blocks: DataFrame, sent: DataFrame, shared, k: int, n_tasks: int) -> DataFrame:
    """The k best of each batch in each block it was sent to. A block goes once to every turn of batches."""
    turns = sent.select("block", "turn").distinct()
    left = blocks.join(turns, "block").select("block", "turn", F.lit(-1).cast("long").alias("batch"), "piece", "ids", "sizes", "flat", F.lit(None).cast("binary").alias("floors"))
    right = sent.select("block", "turn", "batch", F.lit(0).alias("piece"), "ids", "sizes", "flat", "floors")

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, lead = shared.value
        at, block, parts = None, None, []
        for batch in arrow:
            for r in batch.to_pylist():
                if (r["block"], r["turn"]) != at:
                    at, block, parts = (r["block"], r["turn"]), None, []
                if r["batch"] < 0:
                    parts.append((r["ids"], r["sizes"], r["flat"]))
                    continue
                if block is None:
                    block, parts = _unpacked(parts, basis, lead), []
                q = _unpacked([(r["ids"], r["sizes"], r["flat"])], basis, lead)
                best = Best(len(q.ids), k, np.frombuffer(r["floors"], "<f8"))
                search_block(best, q, block)
                exact = best.score.tolist()
                score = [min(max(int(x), LONG[0]), LONG[1]) for x in exact]
                sorts = [_key(int(x)) if x != y else None for x, y in zip(exact, score)]
                columns = (np.full(len(best.q), r["batch"]), q.ids[best.q], best.q, best.id, score)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(sorts, pa.string())], names=["batch", "query_id", "query_no", "vec_id", "score", "sorts"])

    dealt = left.unionByName(right).repartition(n_tasks, "block", "turn").sortWithinPartitions("block", "turn", "batch", "piece")
    return dealt.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rows = Window.partitionBy("batch", "query_no").orderBy(F.desc("score"), F.desc_nulls_last("sorts"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rows)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector: str = "embedding", lead: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, the ``k`` best of all other rows.

    Ties go to the smaller id; queries with fewer partners get them all. Rows that share the query's id are the
    query's own. Vectors of other lengths count as padded by zeros. Scores are compared exactly at every size; one
    beyond the range of long is given as that range's end. An empty table gives no rows.
    """
    spark = table.sparkSession
    kind = "query_id long, rank int, vec_id long, score long"
    rows = written(integer_vectors(table, id_column, vector, scale), "integers")
    size = rows.agg(F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width, n = size["width"], size["n"]
    if not width:
        return spark.createDataFrame([], kind)
    least = min(-(-n // STEP), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(max(1, least, -(-n * width * 8 // BLOCK_BYTES)), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = written(_packed(ordered.withColumn("block", F.spark_partition_id().cast("long")), "block", STEP), "blocks")
    lengths = blocks.groupBy("block").agg(F.max("longest").alias("norm")).orderBy("block").collect()  # one number a block
    names, norms = [r["block"] for r in lengths], np.array([r["norm"] for r in lengths])
    shared = spark.sparkContext.broadcast((rotation(rows, width), min(lead, width)))
    asking = written(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v", "norm").distinct(), "asking")
    n_batches = max(1, -(-asking.count() // QUERIES))
    dealt = asking.withColumn("batch", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_batches))).repartition(n_batches, "batch").sortWithinPartitions("batch", "vec_id")
    batches = written(_packed(dealt, "batch", None), "batches")
    longest = blocks.filter((F.col("block") == names[0]) & (F.col("piece") == 0))
    first = _meet(longest, _sent(batches, None, shared, names[:1], norms[:1], k, FIRST_BATCHES), shared, k, min(4 * -(-n_batches // FIRST_BATCHES), 20_000))
    start = written(_best(first, k).drop("rank"), "start")
    sent = written(_sent(batches, start, shared, names, norms, k, BATCHES), "sent")
    found = _meet(blocks, sent, shared, k, min(4 * len(names) * -(-n_batches // BATCHES), 20_000))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

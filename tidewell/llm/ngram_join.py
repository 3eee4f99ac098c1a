"""N-gram Jaccard join of whole texts, by T-occurrence search.

1. Texts with equal shingle sets are one class (128-bit digest of the set).
2. A class most of whose shingles no other class has can have no partner and is set aside: first by a slice of all
   hashes that is just large enough to tell, then by the rest of them, sent only for the classes that are left.
3. Classes meet by exact signatures: sets within the threshold differ in at most d shingles, so if more than d of k parts
   of the hash range are not empty in one, at least one of these is equal in both. d grows with the size, so sizes are
   banded; a set signs its own band and the bands below that may hold partners. A set with too many empty parts also
   signs by its first shingles. Classes that share a signature form the group of its smallest class.
4. Within each group, T-occurrence search over an inverted index of shingles (DivideSkip): the short lists of a query
   are merged, the longest ones are probed by binary search, and sets that reach the required overlap are linked.
   Groups within another are left out; groups beyond a size are cut into blocks by set size, and blocks that may hold partners meet pairwise, after
   all members were compared with the group's first: what is linked to that needs no other comparison.
5. Components of the links, by distributed star steps.

Shingles are compared by 64-bit hash, sets within a few thousand such hashes at a time.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_TASK_BITS, free_name, written
from .components import connected_components

U64 = np.uint64
#: At most so many 8-byte node numbers, or places of classes in blocks (40 bytes each), are broadcast; beyond that,
#: the join shuffles.
BROADCAST_NODES = 1_000_000
BROADCAST_PLACES = 500_000
#: Shingles (8 bytes each) that a task of the search is given on average.
TASK_SHINGLES = 2_000_000
GOLD = U64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (two multiply-shift rounds)."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    return (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words, of the whole sequence; without words, none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, U64)
    one = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(one, words), dtype=U64, count=len(words))
    n = max(1, len(words) - width + 1)
    with np.errstate(over="ignore"):
        acc = np.full(n, U64(min(width, len(words))) * GOLD, U64)
        for i in range(min(width, len(words))):
            acc = _mix(acc + h[i : i + n]) + GOLD
        return np.unique(_mix(acc))


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den."""

    num: int = 90
    den: int = 100

    def linked(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)

    def overlap_needed(self, a, b):
        return -(-self.num * (a + b) // (self.num + self.den))

    def most_different(self, smaller: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set has this size."""
        return smaller * (self.den - self.num) // self.num

    def smallest_partner(self, n):
        return -(-self.num * n // self.den)

    def largest_partner(self, n):
        return self.den * n // self.num


def bands(limit: int, growth: float = 1.25) -> np.ndarray:
    """Lower ends of the size bands up to ``limit``."""
    ends = [1]
    while ends[-1] <= limit:
        ends.append(max(ends[-1] + 1, int(ends[-1] * growth)))
    return np.array(ends)


_BANDS = bands(1 << 40)


def _parts(hashes: np.ndarray, k: int) -> np.ndarray:
    """Start of each of k equal parts of the hash range in the sorted hashes, and the end."""
    edges = (np.arange(k + 1, dtype=np.float64) * (2.0**64 / k))[1:-1].astype(U64)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


def _sums(mixed: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mixed, dtype=U64)))
    return total[at[1:]] - total[at[:-1]]


def _n_parts(size: int, most: int) -> int:
    """So many parts that of a set of ``size`` shingles more than ``most`` are hardly ever empty; 0 if there are none."""
    k = most + 1
    while k <= min(2 * most + 4, size + 1):
        empty = math.exp(-size / k)
        if k * (1 - empty) - 2 * math.sqrt(k * empty) > most:
            return k
        k += 1 + k // 256
    return 0


@functools.cache
def _band(band: int, t: Threshold) -> tuple[int, int]:
    """For pairs whose smaller set is in this band: how many shingles they differ in at most, and the number of parts."""
    most = t.most_different(int(_BANDS[band + 1]) - 1)
    return most, _n_parts(int(_BANDS[band]), most) if most else 0


def signatures(hashes: np.ndarray, t: Threshold) -> np.ndarray:
    """Signatures of one set: two linked, different sets share at least one.

    Parts that are empty sign nothing. The difference touches at most ``most`` parts, so a set with more parts than that
    which hold anything has one that is equal in the other. Sets with fewer also sign each of their first shingles, one
    more than they may lack: two linked sets share one of those."""
    n = len(hashes)
    out, few = [], False
    first = int(np.searchsorted(_BANDS, t.smallest_partner(n), "right")) - 1
    last = int(np.searchsorted(_BANDS, n, "right")) - 1
    with np.errstate(over="ignore"):
        mixed = _mix(hashes + GOLD)
        for band in range(first, last + 1):
            most, k = _band(band, t)
            if not most:  # linked sets are equal
                continue
            full = np.zeros(1, bool)
            if k:
                at = _parts(hashes, k)
                tag = _mix(np.arange(k, dtype=U64) + U64(band << 32))
                full = np.diff(at) > 0
                out.append(_mix(_sums(mixed, at) + tag)[full])
            few |= int(full.sum()) <= most
        if few:
            out.append(_mix(mixed[: n - t.smallest_partner(n) + 1]))
    return np.unique(np.concatenate(out)) if out else np.empty(0, U64)


class Index:
    """An inverted index of sets, in order of size."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        tokens = np.concatenate(sets) if sets else np.empty(0, U64)
        order = np.argsort(tokens, kind="stable")
        self.tokens, at = np.unique(tokens[order], return_index=True)
        self.starts = np.append(at, len(tokens)).astype(np.int64)
        self.postings = owner[order]

    def search(self, query: np.ndarray, t: Threshold, skip: np.ndarray) -> np.ndarray:
        """Numbers of the sets linked to ``query``, but for those marked in ``skip``."""
        n = len(query)
        low, high = np.searchsorted(self.sizes, [t.smallest_partner(n), t.largest_partner(n) + 1])
        if low >= high or skip[low:high].all():
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        start, length = self.starts[at], self.starts[at + 1] - self.starts[at]
        needed = int(t.overlap_needed(n, int(self.sizes[low])))
        if len(at) < needed:
            return np.empty(0, np.int64)
        by_length = np.argsort(length, kind="stable")
        start, length = start[by_length], length[by_length]
        n_long = min(needed - 1, int(needed / (0.0085 * np.log2(max(2, int(length[-1]))) + 1)))
        n_short = len(start) - n_long
        # merge the short lists: sorted runs, so a stable sort merges them
        s, m = start[:n_short], length[:n_short]
        gather = np.repeat(s - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum()))
        merged = self.postings[gather]
        merged = merged[(merged >= low) & (merged < high)]
        merged = np.sort(merged[~skip[merged]], kind="stable")
        if not len(merged):
            return np.empty(0, np.int64)
        new = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        found, count = merged[new], np.diff(np.append(new, len(merged)))
        want = t.overlap_needed(n, self.sizes[found])
        keep = count + n_long >= want
        found, count, want = found[keep], count[keep], want[keep]
        # probe the long lists, shortest first, while a set can still reach its overlap
        for i in range(n_short, len(start)):
            if not len(found):
                break
            long = self.postings[start[i] : start[i] + length[i]]
            p = np.minimum(np.searchsorted(long, found), len(long) - 1)
            count = count + (long[p] == found)
            keep = count + (len(start) - 1 - i) >= want
            if not keep.all():
                found, count, want = found[keep], count[keep], want[keep]
        return found[t.linked(count, n, self.sizes[found])]


def links_in_block(nodes: np.ndarray, asks: np.ndarray, held: np.ndarray, sets: list[np.ndarray], t: Threshold) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the block's linked sets, each to the smallest of its tree, and the tree's number of each row.

    Rows that ``asks`` are queries, rows that are ``held`` are indexed; a row can be both. A pair in one tree already
    is not looked for again.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    inside = order[held[order]]
    index = Index([sets[i] for i in inside])
    group = np.arange(len(sets))
    for q in order[asks[order]]:
        for y in index.search(sets[q], t, group[inside] == group[q]):
            y = inside[y]
            if group[y] != group[q]:
                group[group == group[y]] = group[q]
    smallest = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, nodes)
    root = smallest[group]
    linked = np.flatnonzero(root != nodes)
    return list(zip(nodes[linked].tolist(), root[linked].tolist())), group


def _classed(docs: DataFrame, width: int) -> DataFrame:
    """node, id, h (hash of the text), n (set size), digest (of the set, null if empty) of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = [], []
            for text in batch.column("text").cast(pa.large_binary()):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                sums.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(sums, pa.binary())], names=["node", "id", "h", "n", "digest"])

    return docs.select("node", "id", F.xxhash64("text").alias("h"), "text").mapInArrow(digest, "node long, id long, h long, n long, digest binary")


def class_number(digest: bytes) -> int:
    """A class's number: the first eight bytes of its digest."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return start, np.diff(np.append(start, len(values)))


def _packed(sign: np.ndarray, number: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows (bucket, classes, counts, signs): per bucket of the signatures' upper bits, their next 40 bits by class."""
    yield from _rows((sign >> U64(64 - bits)).astype(np.int64), (sign << U64(bits)) >> U64(24), number)


def _rows(bucket: np.ndarray, sign: np.ndarray, number: np.ndarray) -> Iterator[tuple]:
    """Rows as above from buckets and signs of 40 bits."""
    order = np.lexsort((number, bucket))
    bucket, number = bucket[order], number[order]
    low = sign[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    at, size = _runs(bucket)
    for s, n in zip(at, size):
        c, k = _runs(number[s : s + n])
        yield int(bucket[s]), number[s : s + n][c].astype("<i8").tobytes(), k.astype("<u4").tobytes(), low[s : s + n].tobytes()


def _dealt(sent: DataFrame, bits: int, coarse: int, *keys) -> DataFrame:
    """Packed rows at the tasks of their buckets, in order of buckets: at most ``2 ** coarse`` tasks. Where there are more
    buckets (``2 ** bits``), rows come packed by coarse buckets, and a task deals its own to fine ones, by the upper bits of
    their signs, and sorts those (on disk, if need be): it never holds more than FLUSH signs, and later one bucket."""
    dealt = sent.repartition(1 << coarse, *keys)
    if bits > coarse:
        more = bits - coarse

        def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def fine() -> pa.RecordBatch:
                bucket, sign, number = (np.concatenate(x) for x in zip(*held))
                return _packed_batch(list(_rows((bucket << more) | (sign >> U64(40 - more)).astype(np.int64), sign, number)))

            for batch in batches:
                for r in batch.to_pylist():
                    if r["bucket"] < 0:
                        yield _packed_batch([tuple(r.values())])
                        continue
                    sign, number = _unpacked(r)
                    held.append((np.full(len(sign), r["bucket"], np.int64), sign, number))
                    n += len(sign)
                    if n > FLUSH:
                        yield fine()
                        held, n = [], 0
            if held:
                yield fine()

        dealt = dealt.mapInArrow(refine, "bucket int, classes binary, counts binary, signs binary")
    return dealt.sortWithinPartitions("bucket")


def _stars(sign: np.ndarray, number: np.ndarray, at_least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (sign, number) pairs in that order: group (smallest number of the sign) and member for all signs that so many
    classes share, each pair once; and which pairs stand in no such sign or first in one."""
    at, size = _runs(sign)
    shared = np.repeat(size >= at_least, size)
    first = np.zeros(len(sign), bool)
    first[at] = True
    group = np.repeat(number[at], size)
    pairs = np.stack([group, number], 1)[shared & ~first & (group != number)]
    pairs = np.unique(pairs, axis=0) if len(pairs) else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1], ~shared | first


#: Among so many signatures of one task, those of at least COMBINE classes are combined before they are sent.
FLUSH = 400_000
COMBINE = 16


PACKED = (("bucket", pa.int32()), ("classes", pa.binary()), ("counts", pa.binary()), ("signs", pa.binary()))


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(PACKED)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, PACKED)], names=[n for n, _ in PACKED])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Signs (their 40 bits) and class numbers of a packed row."""
    raw = np.frombuffer(row["signs"], np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    return wide.view("<u8").ravel(), np.repeat(np.frombuffer(row["classes"], "<i8"), np.frombuffer(row["counts"], "<u4"))


def _new_classes(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Class number and shingles of each class in the batch, once."""
    known = set()
    for text in batch.column("text").cast(pa.large_binary()):
        s = shingle_set(text.as_py(), width)
        if len(s) and (number := class_number(xxhash.xxh3_128_digest(s.tobytes()))) not in known:
            known.add(number)
            yield number, s


#: Parts that the hashes are cut into, by their lowest bits, for slices of them.
SLICED = 1 << 16


def _unshared(docs: DataFrame, width: int, n_shingles: int, per_bucket: int = 3_000_000, most_task_bits: int = MOST_TASK_BITS, low: int = 0, high: int = SLICED) -> DataFrame:
    """(cls, unshared): how many of a class's shingles no other class of these texts has, among those that lie in the slice
    from ``low`` to ``high`` of all hashes. Classes without any are left out. Every shingle is sent once a task, packed;
    only counts come back. A task has several buckets: what a class sends to each, and gets back, holds its number."""
    bits = int(max(6, np.ceil(np.log2(max(1, n_shingles / per_bucket)))))
    coarse = min(max(6, bits - 3), bits, most_task_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, numbers, held = [], [], 0
            for number, s in _new_classes(batch, width):
                if high - low < SLICED:
                    part = s & U64(SLICED - 1)
                    s = s[(part >= U64(low)) & (part < U64(high))]
                sets.append(s)
                numbers.append(np.full(len(s), number))
                held += len(s)
                if held > FLUSH:
                    yield _packed_batch(list(_packed(np.concatenate(sets), np.concatenate(numbers), coarse)))
                    sets, numbers, held = [], [], 0
            if held:
                yield _packed_batch(list(_packed(np.concatenate(sets), np.concatenate(numbers), coarse)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def alone() -> pa.RecordBatch:
            sign, number = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((number, sign))
            sign, number = sign[order], number[order]
            fresh = np.concatenate(([True], (sign[1:] != sign[:-1]) | (number[1:] != number[:-1])))
            sign, number = sign[fresh], number[fresh]
            start, size = _runs(sign)
            cls, n = np.unique(number[start[size == 1]], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64())], names=["cls", "n"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != at:
                    if parts:
                        yield alone()
                    at, parts = r["bucket"], []
                parts.append(_unpacked(r))
        if parts:
            yield alone()

    sent = docs.select("text").mapInArrow(send, "bucket int, classes binary, counts binary, signs binary")
    return _dealt(sent, bits, coarse, "bucket").mapInArrow(count, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("unshared"))


def _with_partners(classes: DataFrame, docs: DataFrame, width: int, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """The classes, and texts of their representatives, that may have a partner at all: a linked set holds at least
    num / den of a class's shingles, so a class with more unshared ones has none. Half as many again as that are in the
    slice that is sent of all classes, so most of those without a partner go by it; the other slice is sent of the rest,
    among whom more is unshared."""
    cut = min(SLICED, SLICED * 3 * (t.den - t.num) // (2 * t.den) + SLICED // 32)
    classes = classes.withColumn("unshared", F.lit(0).cast("long"))
    for low, high in ((0, cut), (cut, SLICED)) if cut < SLICED else ((0, SLICED),):
        n = classes.agg(F.sum("n")).first()[0] or 0
        alone = _unshared(docs, width, n * (high - low) // SLICED, low=low, high=high).withColumnRenamed("unshared", "more")
        counted = classes.join(alone, "cls", "left").withColumn("unshared", F.col("unshared") + F.coalesce("more", F.lit(0))).drop("more")
        classes = written(counted.filter((F.col("n") - F.col("unshared")) * t.den >= F.col("n") * t.num), "sharing")
        nodes = classes.select("node").distinct()
        docs = docs.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, "node", "left_semi")
    return classes.drop("unshared"), docs


def _meetings(docs: DataFrame, width: int, t: Threshold, n_shingles: int, per_bucket: int = 1_000_000, most_task_bits: int = MOST_TASK_BITS) -> DataFrame:
    """(grp, cls) of classes that share a signature with the smaller class grp, each pair once."""
    share = (t.den - t.num) / t.num * 2.2
    bits = int(max(6, np.ceil(np.log2(max(1, n_shingles * share / per_bucket)))))
    coarse = min(bits, most_task_bits)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(signs: list, numbers: list) -> pa.RecordBatch:
            sign, number = np.concatenate(signs), np.concatenate(numbers)
            order = np.lexsort((number, sign))
            sign, number = sign[order], number[order]
            grp, cls, sent = _stars(sign, number, COMBINE)
            rows = list(_packed(sign[sent], number[sent], coarse))
            rows += [(-1, grp.astype("<i8").tobytes(), b"", cls.astype("<i8").tobytes())] if len(grp) else []
            return _packed_batch(rows)

        for batch in batches:
            signs, numbers, held = [], [], 0
            for number, s in _new_classes(batch, width):
                signs.append(signatures(s, t))
                numbers.append(np.full(len(signs[-1]), number))
                held += len(signs[-1])
                if held > FLUSH:
                    yield flushed(signs, numbers)
                    signs, numbers, held = [], [], 0
            if signs:
                yield flushed(signs, numbers)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, signs, numbers = None, [], []

        def pairs_of():
            sign, number = np.concatenate(signs), np.concatenate(numbers)
            order = np.lexsort((number, sign))
            return batch_of(*_stars(sign[order], number[order])[:2], False)

        def batch_of(grp, cls, local):
            return pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(cls, pa.int64()), pa.array(np.full(len(grp), local))], names=["grp", "cls", "local"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] == -1:
                    yield batch_of(np.frombuffer(r["classes"], "<i8"), np.frombuffer(r["signs"], "<i8"), True)
                    continue
                if r["bucket"] != at:
                    if signs:
                        yield pairs_of()
                    at, signs, numbers = r["bucket"], [], []
                sign, number = _unpacked(r)
                signs.append(sign)
                numbers.append(number)
        if signs:
            yield pairs_of()

    sent = docs.select("text").mapInArrow(sign, "bucket int, classes binary, counts binary, signs binary")
    # rows of local pairs have nothing to meet: they go anywhere
    spread = F.when(F.col("bucket") < 0, F.xxhash64("signs")).otherwise(F.col("bucket").cast("long"))
    met = written(_dealt(sent, bits, coarse, spread).mapInArrow(meet, "grp long, cls long, local boolean").distinct(), "met")
    local, wide = met.filter("local").select("grp", "cls"), met.filter(~F.col("local")).select("grp", "cls")
    # who was combined into a class goes where that class goes
    along = local.withColumnsRenamed({"grp": "via"}).join(wide.withColumnsRenamed({"cls": "via"}), "via").select("grp", "cls")
    return local.unionByName(wide).unionByName(along.filter("grp <> cls")).distinct()


def _largest_groups(members: DataFrame) -> DataFrame:
    """``members`` without the groups that lie whole within the group of the smallest class that their first class is
    in: every pair of theirs meets there."""
    above = members.filter("cls <> grp").groupBy(F.col("cls").alias("grp")).agg(F.min("grp").alias("above"))
    placed = members.select("grp", "cls").join(above, "grp")
    there = members.select(F.col("grp").alias("above"), "cls").withColumn("there", F.lit(1))
    inside = placed.join(there, ["above", "cls"], "left").groupBy("grp").agg(F.min(F.coalesce("there", F.lit(0))).alias("whole")).filter("whole = 1")
    return members.join(inside.select("grp"), "grp", "left_anti")


def _tasks(places: DataFrame, classes: DataFrame) -> int:
    """Tasks for a search: as many as the shingles of its places fill at TASK_SHINGLES each, no fewer than shuffles have."""
    n = places.join(classes.select("cls", "n"), "cls").agg(F.sum("n")).first()[0] or 0
    return max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-n // TASK_SHINGLES), 1 << MOST_TASK_BITS), 1)


def _search_blocks(rows: DataFrame, t: Threshold, n_parts: int) -> DataFrame:
    """rows: block columns grp, i, j; cls; asks, held; shingles. Out: (a, b, open): links, and with open the rows
    of star blocks that are not linked to the group's first (a: group, b: class)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, {}

        def done():
            nodes = np.array(list(block))
            asks, held = np.array([r[0] for r in block.values()]), np.array([r[1] for r in block.values()])
            links, group = links_in_block(nodes, asks, held, [r[2] for r in block.values()], t)
            a, b, o = [x for x, _ in links], [y for _, y in links], [False] * len(links)
            if key[1] < 0 and asks.any():  # a star block
                rest = nodes[group != group[np.flatnonzero(asks)[0]]]
                a, b, o = [*a, *[key[0]] * len(rest)], [*b, *rest.tolist()], [*o, *[True] * len(rest)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(o, pa.bool_())], names=["a", "b", "open"])

        for batch in batches:
            sets = batch.column("shingles").to_pylist()
            for g, i, j, cls, asks, held, s in zip(*[batch.column(c).to_pylist() for c in ("grp", "i", "j", "cls", "asks", "held")], sets):
                if (g, i, j) != key:
                    if key is not None:
                        yield done()
                    key, block = (g, i, j), {}
                old = block.get(cls, (False, False, None))
                block[cls] = (asks or old[0], held or old[1], np.frombuffer(s, "<u8"))
        if key is not None:
            yield done()

    dealt = rows.repartition(n_parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return dealt.mapInArrow(search, "a long, b long, open boolean")


def _with_sets(places: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``places`` (cls and block columns) with the class's shingles (packed). The text comes from the class's
    representative; texts under its id that are not of the class are passed over. Places go to the texts by broadcast
    where they are few enough, so that only sets are shuffled."""
    per = places.join(classes.select("cls", "node"), "cls").groupBy("node").agg(F.collect_list(F.struct(*places.columns)).alias("places"))
    per = written(per, "places")
    few = (per.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_PLACES
    met = docs.select("node", "text").join(F.broadcast(per) if few else per, "node")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, numbers = [], []
            for text in batch.column("text").cast(pa.large_binary()):
                s = shingle_set(text.as_py(), width)
                sets.append(s.astype("<u8").tobytes())
                numbers.append(class_number(xxhash.xxh3_128_digest(s.tobytes())) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("places"), pa.array(numbers, pa.int64()), pa.array(sets, pa.binary())], names=["places", "number", "shingles"])

    kind = met.schema["places"].dataType.simpleString()
    out = met.select("text", "places").mapInArrow(shingle, f"places {kind}, number long, shingles binary")
    return out.select(F.explode("places").alias("p"), "number", "shingles").filter(F.col("p.cls") == F.col("number")).select("p.*", "shingles")


def _links(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, t: Threshold, block: int) -> DataFrame:
    """Links between classes that meet in a group. members: grp, cls, n."""
    yes, no = F.lit(True), F.lit(False)
    total = members.groupBy("grp").agg(F.sum("n").alias("total"))
    sized = members.join(total, "grp")
    small = sized.filter(F.col("total") <= block).select("grp", F.lit(0).alias("i"), F.lit(0).alias("j"), "cls", yes.alias("asks"), yes.alias("held"))
    # the hub is the smallest class left of the group: its namesake may have been set aside
    hub = sized.groupBy("grp").agg(F.min("cls").alias("hub"))
    big = written(sized.filter(F.col("total") > block).join(hub, "grp"), "big")
    salts = F.ceil(F.col("total") * 2 / block).cast("int")
    spokes = big.filter("cls <> hub").select("grp", (-1 - F.pmod(F.xxhash64("cls"), salts)).cast("int").alias("i"), F.lit(0).alias("j"), "cls", no.alias("asks"), yes.alias("held"))
    hubs = big.filter("cls = hub").select("grp", F.explode(F.sequence(-salts, F.lit(-1))).alias("i"), F.lit(0).alias("j"), "cls", yes.alias("asks"), no.alias("held"))
    first = written(small.unionByName(spokes).unionByName(hubs), "first")
    found = written(_search_blocks(_with_sets(first, classes, docs, width), t, _tasks(first, classes)), "links")
    links = found.filter(~F.col("open")).select("a", "b")
    unlinked = written(found.filter("open").select(F.col("a").alias("grp"), F.col("b").alias("cls")).distinct(), "unlinked")
    if not unlinked.take(1):
        return links
    rest = big.drop("hub").join(unlinked.withColumn("asks", yes), ["grp", "cls"], "left").withColumn("asks", F.coalesce("asks", no))
    rest = rest.join(unlinked.select("grp").distinct(), "grp", "left_semi")
    # cells: a band of sizes (each the least partner of the next) and a hash part of it; an asking class meets the
    # cells of the bands that may hold partners
    banded = written(rest.withColumn("band", F.floor(F.ln("n") / float(np.log(t.den / t.num))).cast("int")), "rest")
    load = banded.groupBy("grp", "band").agg(F.ceil(F.sum("n") * 2 / block).cast("int").alias("cells"))
    placed = banded.join(load, ["grp", "band"]).withColumn("cell", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("cells")).cast("int"))
    name = lambda band, cell: F.col(band).cast("long") * (1 << 32) + F.col(cell)
    slots = load.select("grp", F.col("band").alias("at"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("c"))
    near = placed.filter("asks").select("grp", "cls", F.explode(F.array(*[F.col("band") + d for d in (-2, -1, 0, 1, 2)])).alias("at"), name("band", "cell").alias("j"))
    asking = near.join(slots, ["grp", "at"]).select("grp", name("at", "c").alias("i"), "j", "cls", yes.alias("asks"), no.alias("held"))
    pairs = asking.select("grp", "i", "j").distinct()
    held = placed.select("grp", name("band", "cell").alias("i"), "cls").join(pairs, ["grp", "i"]).select("grp", "i", "j", "cls", no.alias("asks"), yes.alias("held"))
    both = asking.unionByName(held).groupBy("grp", "i", "j", "cls").agg(F.bool_or("asks").alias("asks"), F.bool_or("held").alias("held"))
    both = written(both, "cells")
    more = _search_blocks(_with_sets(both, classes, docs, width), t, _tasks(both, classes))
    return links.unionByName(more.select("a", "b"))


def node_of() -> F.Column:
    """The node of a row: its id, or a number from the text of a row without one. It names rows, together with the text's
    hash; ids are kept beside it."""
    return F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64("text"), 2))


def jaccard_join(docs: DataFrame, width: int = 5, threshold: Threshold = Threshold(80, 100), block: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """Membership and links of the documents (doc_id, text) whose shingle sets are similar enough.

    Membership: one row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links,
    itself included), class_size (rows with an equal set), and component (a number of its own, null without shingles),
    node and h, which name the row. Links: (a, b) between class numbers, enough to connect every two linked classes.
    Texts that are null, empty or blank have no shingles and link with nothing. Rows are told apart by their texts:
    those that share an id are not linked by it, those without an id can be linked but give no component its name. Ids
    may be negative.
    """
    keyed = docs.select(node_of().alias("node"), F.col("doc_id").cast("long").alias("id"), "text")
    rows = written(_classed(keyed, width), "rows")
    number = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("node").alias("node"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("class_size"), F.first("n").alias("n"))
    classes = written(classes.withColumn("cls", number), "classes")
    sharing, texts = _with_partners(classes.select("cls", "node", "n"), keyed, width, threshold)
    met = _meetings(texts, width, threshold, sharing.agg(F.sum("n")).first()[0] or 0)
    members = written(met.unionByName(met.select("grp", F.col("grp").alias("cls"))).distinct().join(sharing.select("cls", "n"), "cls"), "members")
    members = written(_largest_groups(members), "groups")
    links = written(_links(members, sharing, texts, width, threshold, block), "found")
    parts = connected_components(links, "a", "b").withColumnRenamed("node", "cls")
    named = classes.join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    real = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.select("digest", "class_size", "component").join(real, "component")
    out = rows.join(named, "digest", "left")
    members_out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "component", "node", "h")
    return members_out, links


def one_of_each(docs: DataFrame, width: int = 5, threshold: Threshold = Threshold(80, 100)) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component, the row with the smallest id stays.

    Rows without an id give way to those with one. Rows without shingles stay; rows that repeat an id and a text are
    one. Columns are as in ``docs``.
    """
    members, _ = jaccard_join(docs, width, threshold)
    members = written(members.select("component", "node", "h", F.col("doc_id").isNull().alias("unnamed")), "kept")
    first = members.filter("component is not null").groupBy("component").agg(F.min(F.struct("unnamed", "node", "h")).alias("first"))
    linked = members.join(first, "component")
    lost = linked.filter((F.col("node") != F.col("first.node")) | (F.col("h") != F.col("first.h"))).select(F.col("node").alias("lost_node"), F.col("h").alias("lost_h")).distinct()
    node, h = free_name(docs, "_node"), free_name(docs, "_h")
    rows = docs.withColumns({node: node_of(), h: F.xxhash64("text")})
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_NODES else lost
    rows = rows.join(lost, (F.col(node) == F.col("lost_node")) & (F.col(h) == F.col("lost_h")), "left_anti")
    if members.groupBy("node", "h").count().filter("count > 1").take(1):  # rows that repeat an id and a text
        rows = rows.dropDuplicates([node, h])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Line dedup: drop lines whose key stands in many documents, or all but its first occurrence.

Two Bloom filters hold the hashes of keys seen once and seen twice. They are cut by ranges of the hash: tasks send the
hashes of their lines' keys, packed, to the range's owner, which fills both filters as they come and then names the
hashes whose bits all stand in its twice-filter. There are as many ranges as the volume asks for, on a bounded number of
tasks. Only lines with such a hash are suspected, and only their keys shuffle, counted per batch first, for the exact count of documents and the
choice of the first occurrence. A full filter costs shuffle, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_TASK_BITS, free_name, written

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bits of a range's filters, bits of each hash that are set in them, and bytes of text whose lines one range is to hold.
FILTER_BITS = 22
PROBES = 2
TEXT_PER_RANGE = 16_000_000


def line_keys(text: bytes | None) -> list[bytes]:
    """A key per line: stripped of blanks at both ends, A-Z lower-cased. Null is one empty line."""
    return [x.strip(BLANK).lower() for x in (text or b"").split(b"\n")]


def _bits(hashes: np.ndarray) -> np.ndarray:
    """PROBES bit numbers a hash, from disjoint parts of its lower half."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return np.stack([(hashes >> np.uint64(i * FILTER_BITS)) & mask for i in range(PROBES)])


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _keys_once(text: bytes | None, min_chars: int) -> list[bytes]:
    """The distinct keys of a text that count, in the order of their first lines."""
    return [k for k in dict.fromkeys(line_keys(text)) if k and _long_enough(k, min_chars)]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def suspected_by_range(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Hashes whose bits all stand in the twice-seen filter. ``parts``: hashes seen by one task, each once, and those of
    them that it saw twice."""
    once, twice = (np.zeros(1 << FILTER_BITS, bool) for _ in range(2))
    held = []
    for hashes, again in parts:
        at = _bits(hashes)
        met = once[at].all(axis=0)
        twice[at[:, met]] = True
        twice[_bits(again)] = True
        once[at] = True
        held.append(hashes)
    every = np.unique(np.concatenate(held)) if held else np.empty(0, np.uint64)
    return every[twice[_bits(every)].all(axis=0)]


def _by_range(once: np.ndarray, twice: np.ndarray, bits: int) -> pa.RecordBatch:
    """(part, once, twice): sorted hashes, and those of them seen twice, packed by ranges of the hash."""
    of = (once >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(once), np.int64)
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    again = np.searchsorted(twice, [once[a] for a in cuts])
    rows = [(int(of[a]), once[a:z].astype("<u8").tobytes(), twice[u:v].astype("<u8").tobytes()) for a, z, u, v in zip(cuts, [*cuts[1:], len(of)], again, [*again[1:], len(twice)])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["part", "once", "twice"])


#: Hashes of a task's coarse range that are dealt to its fine ranges at a time.
REFINED = 2_000_000


def suspected_hashes(docs: DataFrame, min_chars: int, range_bits: int, most_task_bits: int = MOST_TASK_BITS) -> DataFrame:
    """(h): 64-bit hashes of the keys that may stand in more than one document; of those that do, all.

    There are ``2 ** range_bits`` ranges but at most ``2 ** most_task_bits`` tasks. Where there are more ranges than tasks,
    hashes are sent packed by a task's coarse range; the task deals them to its fine ranges, sorts those (on disk, if need
    be), and fills the filters of one after the other."""
    coarse = min(range_bits, most_task_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashes(_keys_once(t, min_chars)) for t in _texts(batch)]
            hashes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, int))
            if not len(hashes):
                continue
            yield _by_range(hashes, hashes[n > 1], coarse)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def dealt() -> pa.RecordBatch:
            # a hash that two tasks sent has been seen twice
            once, times = np.unique(np.concatenate([x for x, _ in held]), return_counts=True)
            return _by_range(once, np.union1d(once[times > 1], np.concatenate([x for _, x in held])), range_bits)

        for batch in batches:
            for r in batch.to_pylist():
                held.append((np.frombuffer(r["once"], "<u8"), np.frombuffer(r["twice"], "<u8")))
                n += len(held[-1][0])
                if n > REFINED:
                    yield dealt()
                    held, n = [], 0
        if held:
            yield dealt()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(suspected_by_range(held).view(np.int64), pa.int64())], names=["h"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != at:
                    if held:
                        yield done()
                    at, held = r["part"], []
                held.append((np.frombuffer(r["once"], "<u8"), np.frombuffer(r["twice"], "<u8")))
        if held:
            yield done()

    sent = docs.select("text").mapInArrow(send, "part long, once binary, twice binary")
    sent = sent.repartition(1 << coarse, "part")
    if range_bits > coarse:
        sent = sent.mapInArrow(refine, "part long, once binary, twice binary")
    return sent.sortWithinPartitions("part").mapInArrow(own, "h long")


class _Suspects:
    """Which keys of a text are suspected: by one sorted array for all, or by a list that came with the row."""

    def __init__(self, shared) -> None:
        self.shared = shared

    def of(self, keys: list[bytes], own: list[int] | None) -> list[bytes]:
        known = self.shared.value if self.shared is not None else np.sort(np.array(own or [], np.int64).view(np.uint64))
        if not keys or not len(known):
            return []
        h = _hashes(keys)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return [k for k, same in zip(keys, known[at] == h) if same]


def _with_lists(rows: DataFrame, own: str, keys: DataFrame, make, theirs: str) -> DataFrame:
    """``rows`` with a list of what ``make`` (a mapInArrow function to own, key) and ``keys`` (key, value) share."""
    pairs = rows.mapInArrow(make, f"own long, key {keys.schema['key'].dataType.simpleString()}").distinct()
    per = pairs.join(keys, "key").groupBy("own").agg(F.collect_list("value").alias(theirs))
    return rows.join(per, rows[own] == per["own"], "left").drop("own")


def dedup_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    max_broadcast_bytes: int = 32_000_000,
    text_per_range: int = TEXT_PER_RANGE,
    most_task_bits: int = MOST_TASK_BITS,
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` beside its columns.

    Lines whose key stands in at least ``min_docs`` documents go; with ``keep_first``, the first of them stays, that in
    the document of the smallest doc_id (none last; ties by a hash of the text; rows that repeat both keep it each). A
    row is a document, also where ids repeat. Null and empty texts have one empty line, which is never dropped. Lines
    are compared exactly. Suspected hashes and the keys to drop are broadcast where they measure at most
    ``max_broadcast_bytes``; beyond that, documents meet them in joins. Columns of the added names in ``docs`` are
    replaced.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_dropped")]
    base = docs.select(*[F.col(f"`{c}`") for c in names])
    own, unnamed, theirs, drops_of = (free_name(base, x) for x in ("_own", "_unnamed", "_suspects", "_drops"))
    identity = base["doc_id"].cast("long") if "doc_id" in names else F.lit(None).cast("long")
    rows = base.withColumns({own: F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in names]), unnamed: F.struct(identity.isNull().alias("none"), identity.alias("id"), F.xxhash64("text").alias("h"))})

    volume = base.select(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = int(max(0, np.ceil(np.log2(max(volume, 1) / text_per_range))))
    suspects = written(suspected_hashes(base, min_chars, range_bits, most_task_bits), "suspects")
    shared = None
    if suspects.count() * 8 <= max_broadcast_bytes:
        shared = spark.sparkContext.broadcast(np.sort(suspects.toArrow().column("h").to_numpy().view(np.uint64)))
    else:

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for o, t in zip(batch.column(own).to_pylist(), _texts(batch)):
                    h = _hashes(_keys_once(t, min_chars)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), o), pa.int64()), pa.array(h, pa.int64())], names=["own", "key"])

        rows = _with_lists(rows, own, suspects.select(F.col("h").alias("key"), F.col("h").alias("value")), lines, theirs)
    which = _Suspects(shared)
    lists = lambda batch: batch.column(theirs).to_pylist() if theirs in batch.schema.names else [None] * batch.num_rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[bytes, int] = {}
            first: dict[bytes, tuple] = {}
            for t, known, me in zip(_texts(batch), lists(batch), batch.column(unnamed).to_pylist()):
                place = (me["none"], me["id"] or 0, me["h"] or 0)
                for k in which.of(_keys_once(t, min_chars), known):
                    n[k] = n.get(k, 0) + 1
                    first[k] = min(first.get(k, place), place)
            places = [first[k] for k in n]
            columns = [pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), *(pa.array([p[i] for p in places], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "none", "id", "h"])

    counted = rows.mapInArrow(count, "key binary, n long, none boolean, id long, h long")
    exact = counted.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min(F.struct("none", "id", "h")).alias("first"))
    drops = written(exact.filter(F.col("n_docs") >= min_docs).select("key", "first"), "drops")
    size = drops.select(F.sum(F.octet_length("key") + 150)).first()[0] or 0
    table = None
    if size <= max_broadcast_bytes:
        table = spark.sparkContext.broadcast({bytes(r["key"]): tuple(r["first"]) for r in drops.collect()})
    else:

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for o, t, known in zip(batch.column(own).to_pylist(), _texts(batch), lists(batch)):
                    k = which.of(_keys_once(t, min_chars), known)
                    yield pa.RecordBatch.from_arrays([pa.array([o] * len(k), pa.int64()), pa.array(k, pa.binary())], names=["own", "key"])

        rows = _with_lists(rows, own, drops.select("key", F.struct("key", "first").alias("value")), keys, drops_of)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(drops_of).to_pylist() if table is None else [None] * batch.num_rows
            out = []
            for t, drop, me in zip(_texts(batch), mine, batch.column(unnamed).to_pylist()):
                drop = table.value if table is not None else {d["key"]: tuple(d["first"].values()) for d in drop or ()}
                place = (me["none"], me["id"] or 0, me["h"] or 0)
                out.append(drop_lines(t, drop, place if keep_first else None))
            kept, n, dropped = zip(*out) if out else ((), (), ())
            new = [pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], names=[*names, "kept_text", "n_lines", "n_dropped"])

    added = (T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()))
    return rows.mapInArrow(clean, T.StructType([*base.schema.fields, *added]))


def drop_lines(text: bytes | None, drop, place: tuple | None = None) -> tuple[str, int, int]:
    """Kept text, number of lines, number dropped. ``drop`` maps keys to their first place: a key's first line stays in
    the document at that ``place``."""
    lines = (text or b"").split(b"\n")
    kept, spared = [], set()
    for x in lines:
        k = x.strip(BLANK).lower()
        if k != b"" and k in drop:
            if place is None or k in spared or drop[k] != place:
                continue
            spared.add(k)
        kept.append(x)
    return b"\n".join(kept).decode("utf-8"), len(lines), len(lines) - len(kept)

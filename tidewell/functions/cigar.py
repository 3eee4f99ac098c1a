"""CIGAR strings: decoding, and cutting alignments by path segment (SCL2, SCL23, SEG1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import segment_name, variant_of
from .sequences import reverse_complement

EQ, X, I, D = map(ord, "=XID")  # noqa: E741
_CODES = np.array(sorted((EQ, X, I, D)))
_LETTERS = np.isin(np.arange(256), [ord(c) for c in "MIDNSHP=XB"])


def decode(cigar: Column) -> Column:
    """``3=1X`` as array<struct<op, len>>."""
    lens = F.regexp_extract_all(cigar, F.lit("(\\d+)[MIDNSHP=XB]"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit("\\d+([MIDNSHP=XB])"), F.lit(1))
    return F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))


def merge(ops: Column) -> Column:
    """Adjacent equal operations as one, empty ones dropped."""
    kept = F.filter(ops, lambda x: x["len"] > 0)
    empty = F.expr("cast(array() as array<struct<op:string,len:int>>)")

    def add(acc: Column, x: Column) -> Column:
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == x["op"])
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(x["op"].alias("op"), (F.try_element_at(acc, F.lit(-1))["len"] + x["len"]).alias("len"))))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(kept, empty, add)


def encode(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


_CUTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n in ("side", "cigar") else T.IntegerType()) for n in ("position", "side", "matches", "mismatches", "insertions", "deletions", "query_start", "query_end", "cigar")]))


def _operations(cg: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, one-letter code and length of all operations of a batch of CIGARs, in order: what ``decode`` gives."""
    if not len(cg):
        return (np.empty(0, np.int64),) * 3
    cg = pc.fill_null(cg.cast(pa.large_string()), "")
    at = np.frombuffer(cg.buffers()[1], np.int64)[cg.offset : cg.offset + len(cg) + 1]
    text = np.frombuffer(cg.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    digit = (text >= ord("0")) & (text <= ord("9"))
    end = np.flatnonzero(_LETTERS[text])
    row = np.searchsorted(at, end, "right") - 1
    known = (end > at[row]) & digit[end - 1]
    end, row = end[known], row[known]
    before = np.maximum.accumulate(np.where(digit, -1, np.arange(len(text))))
    begin = np.maximum(before[end - 1] + 1, at[row])
    n = np.zeros(len(end), np.int64)
    for k in range(min(9, int((end - begin).max(initial=0)))):
        n += np.where(k < end - begin, (text[np.maximum(end - 1 - k, 0)].astype(np.int64) - ord("0")) * 10**k, 0)
    for i in np.flatnonzero(end - begin > 9):
        n[i] = min(int(text[begin[i] : end[i]].tobytes()), 1 << 31)
        if n[i] == 1 << 31:
            raise ValueError("an operation of a CIGAR is longer than a whole number of 32 bits")
    return row, text[end].astype(np.int64), n


@dataclass
class _Cuts:
    """The cuts of a batch of reads, in order: their read, their place in its path (-1 and 1 << 30 beside it), sums of =, X,
    I and D with the span on the read, and, where asked, their CIGAR."""

    read: np.ndarray
    place: np.ndarray
    numbers: list[np.ndarray]
    cigars: pa.Array

    @property
    def inside(self) -> np.ndarray:
        return (self.place >= 0) & (self.place < 1 << 30)

    def listed(self, here: np.ndarray) -> pa.ListArray:
        """One list a read, null where it is not ``here``."""
        sides = np.where(self.place < 0, "upstream", "downstream").astype(object)
        sides[self.inside] = None
        arrays = [pa.array(self.place, pa.int32(), mask=~self.inside), pa.array(sides, pa.string()), *[pa.array(x, pa.int32()) for x in self.numbers], self.cigars]
        offsets = np.searchsorted(self.read, np.arange(len(here) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, names=_CUTS.elementType.names), mask=pa.array(~here))


def _cut_arrays(op: np.ndarray, n: np.ndarray, read: np.ndarray, seg_len: np.ndarray, seg_read: np.ndarray, backward: np.ndarray, n_reads: int, with_cigar: bool) -> _Cuts:
    """The cuts of a batch of reads: their operations (one-letter codes and lengths) and path segments, in order. The
    operations of ``backward`` segments are given in the segment's own direction."""
    on_ref, on_query = np.isin(op, (EQ, X, D)), np.isin(op, (EQ, X, I))
    # reads stand one after the other on one long reference, so that one search places all their operations
    total = np.bincount(seg_read, weights=seg_len, minlength=n_reads).astype(np.int64)
    base = np.cumsum(total) - total
    r_len, q_len = np.where(on_ref, n, 0), np.where(on_query, n, 0)
    r0 = np.cumsum(r_len) - r_len
    q0 = np.cumsum(q_len) - q_len
    q0 = q0 - np.append(q0, 0)[np.searchsorted(read, np.arange(n_reads))][read]
    s0 = np.cumsum(seg_len) - seg_len
    s1 = s0 + seg_len
    ends = base + total
    # pieces of what stands on the reference, and insertions within it
    lo = np.searchsorted(s1, r0, "right")
    hi = np.where(on_ref, np.searchsorted(s0, r0 + r_len, "left") - 1, lo)
    inner = on_ref | ((op == I) & (r0 > base[read]) & (r0 < ends[read]))
    count = np.where(inner, np.maximum(hi - lo + 1, 0), 0)
    of = np.repeat(np.arange(len(op)), count)
    seg = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start, stop = np.maximum(r0[of], s0[seg]), np.minimum((r0 + r_len)[of], s1[seg])
    size = np.where(on_ref[of], stop - start, n[of])
    qa = q0[of] + np.where(on_ref[of] & on_query[of], start - r0[of], 0)
    keep = size > 0
    of, seg, size, qa = of[keep], seg[keep], size[keep], qa[keep]
    qb = qa + np.where(on_query[of], size, 0)
    seg_at = np.arange(len(seg_read)) - np.searchsorted(seg_read, seg_read)
    # insertions before the first and after the last base of the path
    out = np.flatnonzero((op == I) & ~inner)
    side = np.where(r0[out] == base[read[out]], -1, 1 << 30)
    owner = np.concatenate((seg_read[seg], read[out]))
    place = np.concatenate((seg_at[seg], side))
    code, size = np.concatenate((op[of], op[out])), np.concatenate((size, n[out]))
    qa, qb = np.concatenate((qa, q0[out])), np.concatenate((qb, q0[out] + n[out]))
    order = np.lexsort((np.concatenate((of, out)), place, owner))
    owner, place, code, size, qa, qb = (x[order] for x in (owner, place, code, size, qa, qb))
    at = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])))) if len(owner) else np.empty(0, np.int64)
    sums = [np.add.reduceat(np.where(code == c, size, 0), at) if len(at) else at for c in (EQ, X, I, D)]
    low, high = (np.minimum.reduceat(qa, at), np.maximum.reduceat(qb, at)) if len(at) else (at, at)
    where, owners = place[at], owner[at]
    inside = (where >= 0) & (where < 1 << 30)
    cigars = pa.nulls(len(at), pa.string())
    if with_cigar and len(at):
        cut = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(code))))
        run = np.flatnonzero(np.concatenate(([True], (cut[1:] != cut[:-1]) | (code[1:] != code[:-1]))))
        turned = np.zeros(len(at), bool)
        turned[inside] = backward[np.searchsorted(seg_read, owners[inside]) + where[inside]]
        turn = np.where(turned[cut[run]], -1, 1) * np.arange(len(run))
        run_of = np.lexsort((turn, cut[run]))
        sizes, codes = np.add.reduceat(size, run)[run_of], code[run][run_of]
        letters = pa.DictionaryArray.from_arrays(pa.array(np.searchsorted(_CODES, codes), pa.int32()), pa.array([chr(c) for c in _CODES])).cast(pa.string())
        texts = pc.binary_join_element_wise(pa.array(sizes).cast(pa.string()), letters, "")
        cigars = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(cut[run], np.arange(len(at) + 1)), pa.int32()), texts), "")
    return _Cuts(owners, where, [*sums, low, high], cigars)


#: Bytes of segment names and lengths, or sequences, that every task may hold.
HELD_BYTES = 64_000_000


def _cut_rows(df: DataFrame, known: dict[str, int], key: str, kept: Sequence[str], made: Sequence[T.StructField], give: Callable, with_cigar: bool, segments: Sequence[str] | None) -> DataFrame:
    """The columns ``kept`` of ``df`` and those ``made`` of its alignments' cuts: ``give`` makes their arrays from the cuts
    of a batch, whether each read has a path and a CIGAR, the batch's different steps, each step's number among these, and
    the reads' first steps. CIGARs are parsed for a whole batch at once."""
    shared = df.sparkSession.sparkContext.broadcast(known)
    single = None if segments is None else set(segments)
    pads = [F.col("query_start"), F.col("path_start"), F.col("path_length") - F.col("path_end"), F.col("query_length") - F.col("query_end")]
    rows = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, key])], F.col("path").alias("_steps"), F.col("cg").alias("_cg"), *[F.coalesce(p.cast("int"), F.lit(0)).alias(f"_pad{i}") for i, p in enumerate(pads)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, cg, keys, n_rows = batch.column("_steps"), batch.column("_cg"), batch.column(key), batch.num_rows
            here = pc.and_(steps.is_valid(), cg.is_valid()).to_numpy(zero_copy_only=False)
            row, op, n = _operations(cg)
            beside = [batch.column(f"_pad{i}").to_numpy().astype(np.int64) for i in range(4)]
            every = np.arange(n_rows)
            read, op, n = (np.concatenate(x) for x in ((every, every, row, every, every), [np.full(n_rows, I), np.full(n_rows, D), op, np.full(n_rows, D), np.full(n_rows, I)], (*beside[:2], n, *beside[2:])))
            held = (n > 0) & here[read]
            order = np.argsort(read[held], kind="stable")
            read, op, n = (x[held][order] for x in (read, op, n))
            seg_read = np.repeat(every, pc.fill_null(pc.list_value_length(steps), 0).to_numpy())
            coded = steps.flatten().dictionary_encode()
            listed = [x or "" for x in coded.dictionary.to_pylist()]
            names = [x[1:] if x[:1] in ("<", ">") else x for x in listed]
            bare = [x.split("=", 1)[0] for x in names]
            number = {x: i for i, x in enumerate(dict.fromkeys(bare))}
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            code, seg_read = code[here[seg_read]], seg_read[here[seg_read]]
            seg_len, backward, of = (np.array([*x, -1], np.int64)[code] for x in ([shared.value.get(x, -1) for x in names], [x[:1] == "<" for x in listed], [number[x] if single is None or x in single else -1 for x in bare]))

            def refuse(at: np.ndarray, why: str) -> None:
                if len(at):
                    raise ValueError(f"{why}: {keys[int(at[0])].as_py()}")

            refuse(read[~np.isin(op, (EQ, X, I, D))], "only =, X, I and D can be cut")
            refuse(seg_read[seg_len < 0], "a segment of the path is not in the segment table")
            pairs = np.sort((seg_read * (len(number) + 1) + of)[of >= 0])
            refuse(pairs[1:][pairs[1:] == pairs[:-1]] // (len(number) + 1), "a segment stands twice in a path")
            total = np.bincount(seg_read, weights=seg_len, minlength=n_rows)
            aligned = np.bincount(read, weights=np.where(op == I, 0, n), minlength=n_rows)
            refuse(np.flatnonzero(here & (total > aligned)), "the path holds more bases than the CIGAR")
            refuse(np.flatnonzero(here & (total < aligned)), "the path holds fewer bases than the CIGAR")
            cuts = _cut_arrays(op, n, read, seg_len, seg_read, backward == 1, n_rows, with_cigar)
            arrays = give(cuts, here, listed, code, np.searchsorted(seg_read, every))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays], names=[*kept, *[f.name for f in made]])

    return rows.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], *made]))


def _held_segments(segment_lengths: DataFrame) -> list:
    """Name, length, bare name, variant and variant as a whole number of each segment; an error where names and lengths
    measure above 64 MB."""
    measured = segment_lengths.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    if measured > HELD_BYTES:
        raise ValueError("the segment table is too large to be held by every task")
    name, variant = F.col("name"), variant_of(F.col("name"))
    return segment_lengths.select(name, "length", segment_name(name).alias("segment"), variant.alias("variant"), variant.try_cast("int").alias("whole")).collect()


def with_cuts(df: DataFrame, segment_lengths: DataFrame, key: str = "name", into: str = "cuts", with_cigar: bool = False, segments: Sequence[str] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with its alignments cut by path segment (SEG1), as an array of structs: position in the path, side
    (``upstream``, ``downstream``; null for segments), matches, mismatches, insertions, deletions, query_start,
    query_end and, if asked, the segment's own cigar, in the segment's direction. No shuffle: a read's path and CIGAR
    stand in its row.

    ``df``: key, path, path_start, path_end, path_length, query_start, query_end, query_length, cg. Unaligned path ends
    count as deletions and unaligned query ends as insertions. An insertion on a boundary belongs to the segment after
    it; what stands before the first and after the last base of the path is upstream and downstream. Null paths or
    CIGARs give null. Errors: an operation other than = X I D, a segment twice in one path, whatever its variants
    (``segments``: names, without variant, for which this counts; None: all), a segment without a length, a path with
    more or fewer bases than its CIGAR. ``segment_lengths``: (name, length) of the graph, held by every task; where names
    and lengths measure above 64 MB it is an error. ``keep``: the columns of ``df`` that stay (None: all).
    """
    known = {r["name"]: int(r["length"]) for r in _held_segments(segment_lengths)}
    kept = [c for c in (df.columns if keep is None else dict.fromkeys(keep)) if c != into]

    def give(cuts: _Cuts, here: np.ndarray, *_) -> list[pa.Array]:
        return [cuts.listed(here)]

    return _cut_rows(df, known, key, kept, [T.StructField(into, _CUTS)], give, with_cigar, segments)


def integer_variants(segment_lengths: DataFrame, segment: str | None = None) -> bool:
    """Whether all variants in the segment table (of one segment) are whole numbers, and there are any."""
    of = segment_lengths.select(segment_name(F.col("name")).alias("s"), variant_of(F.col("name")).alias("v")).filter(F.col("v").isNotNull())
    if segment is not None:
        of = of.filter(F.col("s") == segment)
    n, whole = of.agg(F.count("v"), F.count(F.col("v").try_cast("int"))).first()
    return n > 0 and n == whole


def _described(cut: Column, path: Column) -> list[Column]:
    step = F.when(cut["position"].isNotNull(), F.get(path, cut["position"]))
    return [
        F.coalesce(cut["side"], segment_name(step)).alias("segment"), variant_of(step).alias("variant"), step.startswith("<").alias("reverse_complement"),
        *[cut[c].alias(c) for c in ("matches", "mismatches", "insertions", "deletions", "query_start", "query_end")],
    ]


def cut_by_segment(
    df: DataFrame, segment_lengths: DataFrame, key: str = "name", with_cigar: bool = False, seq: str | None = None, phred: str | None = None,
    segments: Sequence[str] | None = None, separate_ends: bool = True,
) -> DataFrame:
    """Per read and path segment: position, segment, variant, orientation, matches, mismatches, insertions, deletions,
    query span (SEG1), and where asked the segment's CIGAR, its part of the read (``seq``) and of its scores (``phred``,
    an array). Segments that the path holds in reverse (``<``) have all three in the segment's own direction: the
    sequence complemented, scores and operations turned. The span stays the read's.

    ``segments``: only these, named without variant (None: all). ``separate_ends``: with rows for what stands before and
    after the path. Variants are whole numbers if all in the segment table are. Reads without a path or CIGAR have no
    rows; see ``with_cuts`` for what is an error."""
    asked = [c for c in dict.fromkeys([key, "path", seq, phred]) if c]
    rows = with_cuts(df, segment_lengths, key, "_cuts", with_cigar, segments, asked).select(*asked, F.explode("_cuts").alias("_c"))
    c = F.col("_c")
    span = (c["query_start"] + 1, c["query_end"] - c["query_start"])
    more = [c["cigar"].alias("cigar")] if with_cigar else []
    more += [F.substring(F.col(seq), *span).alias("seq")] if seq else []
    more += [F.slice(F.col(phred), *span).alias("phred")] if phred else []
    out = rows.select(key, c["position"].alias("position"), *_described(c, F.col("path")), *more)
    turned = {}
    if seq:
        turned["seq"] = F.when(F.col("reverse_complement"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    if phred:
        turned["phred"] = F.when(F.col("reverse_complement"), F.reverse("phred")).otherwise(F.col("phred"))
    if integer_variants(segment_lengths):
        turned["variant"] = F.col("variant").cast("int")
    out = out.withColumns(turned) if turned else out
    if segments is not None:
        out = out.filter(F.col("segment").isin(*segments))
    return out if separate_ends else out.filter(F.col("position").isNotNull())


def segment_structs(df: DataFrame, segment_lengths: DataFrame, segments: Sequence[str], key: str = "name", keep: Sequence[str] | None = None) -> DataFrame:
    """One row per read, a struct column for each of the given segments (names without variant; SEG1), null where the
    path does not hold it. A segment's variants are whole numbers if all of its in the segment table are. A path that
    holds one of them twice is an error. ``keep``: the columns of ``df`` that stay (None: all). No shuffle."""
    asked, table = list(dict.fromkeys(segments)), _held_segments(segment_lengths)
    whole = {r["name"]: r["whole"] for r in table}
    variants = {s: [r["whole"] for r in table if r["segment"] == s and r["variant"] is not None] for s in asked}
    integer = {s: bool(v) and None not in v for s, v in variants.items()}
    names = ("matches", "mismatches", "insertions", "deletions", "query_start", "query_end")
    fields = {s: T.StructType([T.StructField("segment", T.StringType()), T.StructField("variant", T.IntegerType() if integer[s] else T.StringType()), T.StructField("reverse_complement", T.BooleanType()), *[T.StructField(n, T.IntegerType()) for n in names]]) for s in asked}

    def give(cuts: _Cuts, here: np.ndarray, listed: list[str], code: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        step = np.full(len(cuts.read), len(listed))  # beside the path: none
        step[cuts.inside] = code[(first[cuts.read] + cuts.place)[cuts.inside]]
        bare = [x[1:] if x[:1] in ("<", ">") else x for x in listed]
        back = np.array([*[x[:1] == "<" for x in listed], False])
        out = []
        for s in asked:
            held = np.array([*[x.split("=", 1)[0] == s for x in bare], False])[step]
            held |= (cuts.place == {"upstream": -1, "downstream": 1 << 30}.get(s, -2))
            at = np.flatnonzero(held)
            reads, one = np.unique(cuts.read[at], return_index=True)
            cut = np.full(len(here), -1)
            cut[reads] = at[one]
            none, of = cut < 0, np.append(step, len(listed))[cut]
            known = [whole.get(x) if integer[s] else x.split("=", 1)[1] if "=" in x else None for x in bare]
            variant = pa.array([*known, None], pa.int32() if integer[s] else pa.string()).take(pa.array(of))
            arrays = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(here), np.int32)), pa.array([s])).cast(pa.string()), variant, pa.array(back[of], mask=of == len(listed))]
            arrays += [pa.array(np.append(x, 0)[cut], pa.int32()) for x in cuts.numbers]
            out.append(pa.StructArray.from_arrays(arrays, names=fields[s].names, mask=pa.array(none)))
        return out

    kept = df.columns if keep is None else list(dict.fromkeys(keep))
    made = [T.StructField(f"_segment{i}", fields[s]) for i, s in enumerate(asked)]
    out = _cut_rows(df, {r["name"]: int(r["length"]) for r in table}, key, kept, made, give, False, segments)
    return out.withColumns({s: F.col(f"_segment{i}") for i, s in enumerate(asked)}).drop(*[f.name for f in made])


def gapped(read: Column, cigar: Column, start: Column, reference_length: Column) -> Column:
    """The read laid on its reference: dashes before, after and at deletions, insertions left out (SCL23)."""
    zero = F.struct(F.lit(1).alias("q"), F.lit("").alias("s"))

    def lay(acc: Column, x: Column) -> Column:
        n, op = x["len"], x["op"]
        piece = F.when(op.isin("M", "=", "X"), F.substring(read, acc["q"], n)).when(op == "D", F.repeat(F.lit("-"), n)).otherwise("")
        step = F.when(op.isin("M", "=", "X", "I", "S"), n).otherwise(0)
        return F.struct((acc["q"] + step).alias("q"), F.concat(acc["s"], piece).alias("s"))

    body = F.aggregate(decode(cigar), zero, lay, lambda acc: acc["s"])
    return F.rpad(F.concat(F.repeat(F.lit("-"), start), body), reference_length, F.lit("-"))

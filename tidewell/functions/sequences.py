"""Nucleotide strings: complements, distances, motifs, sites (SCL1, SCL8, SCL14-19)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases and their complements.
BASES, COMPLEMENTS = "ACGTacgtNn", "TGCAtgcaNn"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), BASES, COMPLEMENTS)


def chars(s: Column) -> Column:
    """The characters of a string as an array; an empty string has none."""
    return F.filter(F.split(s, ""), lambda c: c != "")


#: Strings longer than this are compared by blocks of so many characters first.
BLOCK = 64


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of strings of one length; N differs from nothing; unequal lengths are an error. Long strings are
    cut into blocks, and only blocks that differ are compared by character."""

    def by_char(a: Column, b: Column) -> Column:
        pairs = F.zip_with(chars(a), chars(b), lambda x, y: F.when((x == y) | (x == "N") | (y == "N"), 0).otherwise(1))
        return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)

    blocks = lambda s: F.regexp_extract_all(s, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    differing = F.filter(F.arrays_zip(blocks(a).alias("a"), blocks(b).alias("b")), lambda p: p["a"] != p["b"])
    by_block = F.aggregate(differing, F.lit(0), lambda s, p: s + by_char(p["a"], p["b"]))
    total = F.when(F.length(a) > BLOCK, by_block).otherwise(by_char(a, b))
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("strings of unequal length")).cast("int")).otherwise(total)


def umi_by_handle(seq: Column, handle: str, n: int, before: bool = False, reverse: Column | None = None) -> Column:
    """The ``n`` bases after (or before) a handle, complemented on reverse reads; null without a whole one.

    A handle at the very start of the read does not count, as in the reads this was made for.
    """
    read = seq if reverse is None else F.when(reverse, reverse_complement(seq)).otherwise(seq)
    at = F.instr(read, handle)
    start = at - n if before else at + len(handle)
    whole = (at > 1) & (start >= 1) & (start + n - 1 <= F.length(read))
    return F.when(whole, F.substring(read, start, F.lit(n)))


def has_any_site(seq: Column, sites: Sequence[str]) -> Column:
    """Whether a restriction site occurs in the sequence or its reverse complement."""
    flags = [x.contains(s) for s in sites for x in (seq, reverse_complement(seq))]
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def _at_motif(letters: Column, motif: str) -> Column:
    """All 0-based starts of a motif, overlapping ones too, in an array of characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(letters) - len(motif), F.lit(0)))
    same = lambda i: reduce(and_, [F.get(letters, i + k) == c for k, c in enumerate(motif)])
    return F.filter(starts, same)


def _with_chars(seq: Column, make) -> Column:
    """``make`` of the sequence's characters, an array that is made once: time stays linear in the length."""
    return F.flatten(F.transform(F.array(chars(seq)), make))


def motif_positions(seq: Column, motif: str) -> Column:
    """All 0-based starts of a motif, overlapping ones too."""
    return _with_chars(seq, lambda letters: _at_motif(letters, motif))


def motif_sites(df: DataFrame, seq: str, motif: str) -> DataFrame:
    """Occurrences on both strands: strand, start on the forward strand, one row each (SCL17)."""
    plus = F.transform(motif_positions(F.col(seq), motif), lambda i: F.struct(F.lit("+").alias("strand"), i.alias("start")))
    other = motif_positions(reverse_complement(F.col(seq)), motif)
    minus = F.transform(other, lambda i: F.struct(F.lit("-").alias("strand"), (F.length(F.col(seq)) - i - len(motif)).alias("start")))
    return df.withColumn("site", F.explode(F.concat(plus, minus))).select("*", "site.strand", "site.start").drop("site")


def pam_sites(df: DataFrame, seq: str, pam: str = "CC", gap: int = 3, length: int = 20) -> DataFrame:
    """Targets of ``length`` bases that start ``gap`` bases after a PAM, both strands: strand, start, end, target."""

    def on(strand: str, s: Column) -> Column:
        def sites(letters: Column) -> Column:
            n = F.size(letters)
            whole = F.filter(_at_motif(letters, pam), lambda i: i + gap + length <= n)
            ends = (lambda i: (i + gap, i + gap + length)) if strand == "+" else (lambda i: (n - i - gap - length, n - i - gap))
            target = lambda i: F.array_join(F.slice(letters, i + gap + 1, F.lit(length)), "")
            return F.transform(whole, lambda i: F.struct(F.lit(strand).alias("strand"), ends(i)[0].alias("start"), ends(i)[1].alias("end"), target(i).alias("target")))

        return _with_chars(s, sites)

    found = F.concat(on("+", F.col(seq)), on("-", reverse_complement(F.col(seq))))
    return df.withColumn("site", F.explode(found)).select("*", "site.*").drop("site")


def mismatch_series(df: DataFrame, seq: str, n: int, seed: int = 0) -> DataFrame:
    """Cumulative substitutions from the far end, 0 to ``n`` of them: mismatches, variant (SCL18).

    The k-th base from the front is replaced by one of its three others, chosen by a hash of sequence, place and seed.
    """
    base = F.col(seq)
    pick = lambda i: F.element_at(F.filter(F.array(*map(F.lit, "ACGT")), lambda b: b != F.substring(base, i, F.lit(1))), F.pmod(F.xxhash64(base, i, F.lit(seed)), F.lit(3)).cast("int") + 1)
    front = F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(n)), lambda i: i <= F.col("mismatches")), pick), "")
    out = df.withColumn("mismatches", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return out.withColumn("variant", F.concat(front, F.substring(base, F.col("mismatches") + 1, F.length(base))))


def good_seed(seq: Column, bad: Sequence[str], length: int = 5) -> Column:
    """Whether the last bases are not on the list of bad seeds (SCL19)."""
    return ~F.substring(seq, -length, length).isin(*bad)


def intervals_of(lengths: Sequence[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """(name, start, end) of segments that follow each other (SCL24)."""
    ends = list(accumulate(n for _, n in lengths))
    return [(name, end - n, end) for (name, n), end in zip(lengths, ends)]


def slice_intervals(seq: Column, intervals: Sequence[tuple[str, int, int]]) -> Column:
    """array<struct<segment, slice>>: the parts [start, end) of a sequence, whole ones only, else null (SCL24)."""
    part = lambda a, b: F.when(F.length(seq) >= b, F.substring(seq, F.lit(a + 1), F.lit(b - a)))
    return F.array(*[F.struct(F.lit(name).alias("segment"), part(a, b).alias("slice")) for name, a, b in intervals])


def segment_distances(seq: Column, reference: Column, intervals: Sequence[tuple[str, int, int]]) -> Column:
    """array<struct<segment, distance>>: Hamming distance of each part to the reference's; null where one is cut short."""
    pairs = F.arrays_zip(slice_intervals(seq, intervals).alias("a"), slice_intervals(reference, intervals).alias("b"))
    return F.transform(pairs, lambda p: F.struct(p["a"]["segment"].alias("segment"), hamming(p["a"]["slice"], p["b"]["slice"]).alias("distance")))

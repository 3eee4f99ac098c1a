"""Oriented paths through a segment graph: arrays of ``>name`` and ``<name`` (PRJ1, PRJ2, PRJ4, PRJ5, SCL3-7, SET4)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distances import edit_distance
from .sequences import reverse_complement


def parse_path(text: Column) -> Column:
    """``>a<b`` as an array of oriented segments."""
    return F.regexp_extract_all(text, F.lit("[<>][^<>]+"), F.lit(0))


def flip(segment: Column) -> Column:
    return F.concat(F.translate(F.substring(segment, 1, 1), "<>", "><"), F.substring(segment, F.lit(2), F.length(segment)))


def segment_name(segment: Column, variant_sep: str | None = "=") -> Column:
    bare = F.regexp_replace(segment, "^[<>]", "")
    return F.substring_index(bare, variant_sep, 1) if variant_sep else bare


def variant_of(segment: Column, sep: str = "=") -> Column:
    """What follows ``name=``, or null."""
    at = F.instr(segment, sep)
    return F.when(at > 0, F.substring(segment, at + len(sep), F.length(segment)))


def _array(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def normalize_paths(df: DataFrame, forward_segments: Sequence[str], path: str = "path") -> DataFrame:
    """Keeps the given segments, and turns reverse paths forward (PRJ1).

    Adds full_path and reverse_complement; paths that hold both orientations of the given segments, or none, become
    null with a null flag. A null path stays null.
    """
    forward = [f">{s}" for s in forward_segments]
    backward = [f"<{s}" for s in forward_segments]
    p = F.col(path)
    kept = F.filter(p, lambda s: F.array_contains(_array([*forward, *backward]), s))
    has_f, has_b = F.arrays_overlap(p, _array(forward)), F.arrays_overlap(p, _array(backward))
    flag = F.when(has_f & ~has_b, False).when(has_b & ~has_f, True)
    turned = F.when(flag, F.reverse(F.transform(kept, flip))).when(~flag, kept)
    return df.withColumns({"full_path": p, "reverse_complement": flag, path: turned})


def flag_end_to_end(df: DataFrame, endpoints: tuple[Sequence[str], Sequence[str]], path: str = "path", into: str = "end_to_end") -> DataFrame:
    """Whether the path holds a segment of each end, in either orientation (PRJ2)."""
    if not all(endpoints):
        raise ValueError("both endpoint sets need segments")
    ends = [F.arrays_overlap(F.col(path), _array([o + s for s in e for o in "<>"])) for e in endpoints]
    return df.withColumn(into, ends[0] & ends[1])


def filter_segments(segments: DataFrame, include: Sequence[str] = (), include_prefix: Sequence[str] = (), exclude: Sequence[str] = (), exclude_prefix: Sequence[str] = (), name: str = "name") -> DataFrame:
    """Segments by exact name or prefix: with any include, only what is included; excludes win (PRJ4)."""

    def any_of(names: Sequence[str], prefixes: Sequence[str]) -> Column:
        out = F.lit(False)
        if names:
            out = out | F.col(name).isin(*names)
        for p in prefixes:
            out = out | F.col(name).startswith(p)
        return out

    kept = any_of(include, include_prefix) if include or include_prefix else F.lit(True)
    return segments.filter(kept & ~any_of(exclude, exclude_prefix))


def drop_dangling_links(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Links both of whose ends are still segments."""
    names = segments.select("name").distinct()
    return links.join(names.withColumnRenamed("name", "from_name"), "from_name", "left_semi").join(names.withColumnRenamed("name", "to_name"), "to_name", "left_semi").select(*links.columns)


def unique_segments(df: DataFrame, path: str, variant_sep: str | None = "=") -> DataFrame:
    """Distinct segment names that the paths use, without orientation and variant (PRJ5)."""
    return df.select(F.explode(path).alias("s")).select(segment_name(F.col("s"), variant_sep).alias("segment")).distinct()


def barcode_string(path: Column, bits: Sequence[str]) -> Column:
    """One character a bit: 1 where the path holds ``bit=1`` in either orientation (SCL3)."""
    flags = [F.when(F.arrays_overlap(path, _array([f">{b}=1", f"<{b}=1"])), "1").otherwise("0") for b in bits]
    return F.concat(*flags)


def traversal_barcode(path: Column, strand: Column, landmarks: tuple[str, str], prefix: str = "BIT") -> Column:
    """Bits of a graph traversal that holds both landmarks, in forward order: 1 for ``...ON`` (SCL4)."""
    names = F.transform(path, lambda s: F.regexp_replace(s, "^[<>]", ""))
    ordered = F.when(strand == "-", F.reverse(names)).otherwise(names)
    bits = F.transform(F.filter(ordered, lambda s: s.startswith(prefix)), lambda s: F.when(s.endswith("ON"), "1").otherwise("0"))
    whole = F.array_contains(names, landmarks[0]) & F.array_contains(names, landmarks[1])
    return F.when(whole, F.array_join(bits, ""))


def permute_bits(barcode: Column, order: Sequence[int], removed: Sequence[int] = ()) -> Column:
    """Bits in cycle order, removed ones as 0 (SCL5)."""
    return F.concat(*[F.lit("0") if i in set(removed) else F.substring(barcode, i + 1, 1) for i in order])


def signal_barcode(signal: Column, thresholds: Sequence[float], removed: Sequence[int] = ()) -> Column:
    """1 where a position's signal is above its threshold, removed positions 0 (SCL6)."""
    marks = F.array(*[F.lit(float("inf") if i in set(removed) else float(t)) for i, t in enumerate(thresholds)])
    return F.array_join(F.zip_with(signal, marks, lambda x, t: F.when(x > t, "1").otherwise("0")), "")


def assemble_sequence(df: DataFrame, path: str, key: str, segments: DataFrame, into: str = "reference_seq", held_bytes: int = 64_000_000) -> DataFrame:
    """The sequence along each path, reverse-complemented on ``<`` (SCL7). ``segments``: (name, seq). A segment of a path
    that is not among them is an error; null and empty paths give null.

    Segments that measure at most ``held_bytes`` are held by every task, and nothing is shuffled; beyond that steps are
    joined with them, for which ``key`` must be unique."""
    size = segments.agg(F.sum(F.octet_length("name") + F.coalesce(F.octet_length("seq"), F.lit(0)) + 128)).first()[0] or 0
    unknown = lambda step: F.raise_error(F.concat(F.lit("a segment of the path is not among the segments: "), step)).cast("string")
    if size > held_bytes:
        steps = df.select(key, F.posexplode(path).alias("pos", "step")).withColumn("_segment", F.regexp_replace("step", "^[<>]", ""))
        placed = steps.join(segments.select(F.col("name").alias("_segment"), "seq"), "_segment", "left")
        found = F.coalesce("seq", unknown(F.col("step")))
        piece = F.when(F.col("step").startswith("<"), reverse_complement(found)).otherwise(found)
        joined = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("s")))).alias("parts"))
        return df.join(joined.select(key, F.array_join(F.col("parts.s"), "").alias(into)), key, "left")
    both = segments.select(F.concat(F.lit(">"), "name").alias("step"), "seq").unionByName(segments.select(F.concat(F.lit("<"), "name").alias("step"), reverse_complement(F.col("seq")).alias("seq")))
    shared = df.sparkSession.sparkContext.broadcast({r["step"]: r["seq"] for r in both.filter(F.col("seq").isNotNull()).collect()})

    @F.pandas_udf("array<string>")
    def pieces(paths: pd.Series) -> pd.Series:
        known = shared.value
        return paths.map(lambda steps: None if steps is None else [known.get(s if s[:1] in ("<", ">") else f">{s}") for s in steps])

    found = pieces(F.col(path))
    missing = F.exists("_pieces", lambda s: s.isNull())
    whole = F.when(missing, unknown(F.array_join(F.col(path), ""))).otherwise(F.when(F.size("_pieces") > 0, F.array_join("_pieces", "")))
    return df.withColumn("_pieces", found).withColumn(into, whole).drop("_pieces")


def reference_distance(df: DataFrame, path: str, key: str, seq: str, segments: DataFrame, into: str = "distance", at_most: int | None = None) -> DataFrame:
    """Edit distance of each sequence to the one assembled along its path, upper-cased (SEG2); null where either is
    empty, -1 beyond ``at_most``. Adds reference_seq and ``into``."""
    out = assemble_sequence(df, path, key, segments)
    filled = lambda c: F.when(F.length(c) > 0, F.upper(c))
    return out.withColumn(into, edit_distance(filled(F.col(seq)), filled(F.col("reference_seq")), at_most))


def cross_run_error(a: DataFrame, b: DataFrame, path_hash: str, seq: str) -> DataFrame:
    """Edit distances of two runs' consensus sequences of one path: distance, n, share (SEG4). Paths of one run only do
    not count; ``path_hash`` is unique on either side."""
    both = a.select(path_hash, F.col(seq).alias("_a")).join(b.select(path_hash, F.col(seq).alias("_b")), path_hash)
    counts = both.select(edit_distance(F.col("_a"), F.col("_b")).alias("distance")).groupBy("distance").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def mismatched_bits(a: Column, b: Column) -> Column:
    """Names of which the two paths hold different variants (SET4)."""
    left, right = F.array_except(a, b), F.array_except(b, a)
    names = lambda x: F.transform(x, lambda s: segment_name(s))
    return F.array_sort(F.array_intersect(names(left), names(right)))

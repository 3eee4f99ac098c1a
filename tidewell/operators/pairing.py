"""Pairing reads: as-of duplex pairs, parent checks, alignments (JON1-3, AGG37, WIN12, WIN18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import micros
from .numbering import around_on_line


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, right_id: str, tolerance_us: int) -> DataFrame:
    """For each left row the first right row at or after its time, at most ``tolerance_us`` later (JON2).

    Adds ``match_<right_id>`` and ``match_time``, null without a match. Both sides are put in order by range partitions of
    even size, whatever one key holds of all rows; a range gets the first right row of the ranges after it from one row a
    range (``around_on_line``, with time turned round). Among right rows of one time the smallest id is first.
    """
    back = lambda t: -micros(t)
    marks = right.filter(F.col(right_time).isNotNull()).groupBy(*by, back(right_time).alias("_t")).agg(F.min(right_id).alias("_id"))
    out = around_on_line(left.withColumn("_t", back(left_time)), marks, by, "_t", "_id")
    near = F.col("_t") - F.col("before.at") <= tolerance_us
    found = [F.when(near, F.col("before.mark")).alias(f"match_{right_id}"), F.when(near, F.timestamp_micros(-F.col("before.at"))).alias("match_time")]
    return out.select(*by, *[c for c in left.columns if c not in by], *found)


def duplex_pairs(reads: DataFrame, tolerance_s: float = 3.0, min_quality: float = 8.0) -> DataFrame:
    """Template and complement reads of one channel: the second starts within the tolerance of the first's end and its
    path is the first's, reversed (JON2). ``reads``: name, ch, mx, st, du, qs, path."""
    from ..functions.paths import flip

    good = reads.filter(F.col("qs") >= min_quality)
    left = good.withColumn("ends", F.timestamp_micros(micros("st") + F.round(F.col("du") * 1e6).cast("long")))
    paired = asof_forward(left.select("ch", "mx", "name", "path", "ends"), good.select("ch", "mx", "name", "st"), ["ch", "mx"], "ends", "st", "name", int(tolerance_s * 1e6))
    other = good.select(F.col("name").alias("match_name"), F.col("path").alias("other_path"))
    joined = paired.filter("match_name is not null and match_name <> name").join(other, "match_name")
    return joined.filter(F.col("path") == F.reverse(F.transform("other_path", flip))).select("name", "match_name")


def join_reads_and_alignments(reads: DataFrame, alignments: DataFrame, name: str = "name", include_unaligned: bool = True) -> DataFrame:
    """Alignments put to their reads (JON1). A name that no read has is an error, raised when the rows are made."""
    known = reads.select(name).distinct().withColumn("_known", F.lit(True))
    checked = alignments.join(known, name, "left").withColumn(name, F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no read named "), F.col(name)))).otherwise(F.col(name))).drop("_known")
    return reads.join(checked, name, "left" if include_unaligned else "inner")


def primary_alignments(alignments: DataFrame, name: str = "name", rank: str = "aln_rank", path: str = "path") -> DataFrame:
    """Flags the first alignment of each name that has a path, and names seen more than once (WIN12)."""
    first = F.row_number().over(Window.partitionBy(name).orderBy(rank)) == 1
    return alignments.withColumns({"is_primary_alignment": first & F.col(path).isNotNull(), "is_duplicated": F.count(F.lit(1)).over(Window.partitionBy(name)) > 1})


def flag_valid_duplex(df: DataFrame, name: str, path: str, reverse: str) -> DataFrame:
    """``is_valid`` of duplex rows and of their parents (JON3).

    A duplex row, named ``a;b``, is valid if exactly two parent rows are there, both on its path, one of them reverse;
    parents of a valid duplex are not valid themselves, other reads are. A parent of several duplexes is invalid if any
    of them is valid. ``path`` may be any comparable column.
    """
    duplex = df.filter(F.col(name).contains(";")).select(F.col(name).alias("_duplex"), F.col(path).alias("_path"), F.explode(F.split(name, ";")).alias("_parent"))
    rows = df.select(F.col(name).alias("_parent"), F.col(path).alias("_own"), F.col(reverse).alias("_rc"))
    met = duplex.join(rows, "_parent", "left")
    judged = met.groupBy("_duplex").agg(
        (F.count("_own") == 2).alias("two"), F.coalesce(F.bool_and(F.col("_own") == F.col("_path")), F.lit(False)).alias("same"), (F.coalesce(F.sum(F.col("_rc").cast("int")), F.lit(0)) == 1).alias("one"),
    ).select("_duplex", (F.col("two") & F.col("same") & F.col("one")).alias("_ok"))
    of_parent = duplex.select("_duplex", "_parent").distinct().join(judged, "_duplex").groupBy("_parent").agg(F.bool_or("_ok").alias("_used"))
    out = df.join(judged, df[name] == judged["_duplex"], "left").join(of_parent, df[name] == of_parent["_parent"], "left")
    valid = F.when(F.col(name).contains(";"), F.coalesce("_ok", F.lit(False))).otherwise(~F.coalesce("_used", F.lit(False)))
    return out.withColumn("is_valid", valid).drop("_duplex", "_ok", "_parent", "_used")


def duplex_census(df: DataFrame, status: str, pair: str, pairs: Sequence[str], match: Column) -> DataFrame:
    """Rows by duplex status and the pair of parents' statuses, matches and mismatches apart, as a table (AGG37)."""
    counted = df.groupBy(status, pair, match.alias("_match")).count()
    key = F.concat_ws("_", pair, F.when(F.col("_match"), "match").otherwise("mismatch"))
    cells = [f"{p}_{m}" for p in pairs for m in ("match", "mismatch")]
    return counted.withColumn("_cell", key).groupBy(status).pivot("_cell", cells).agg(F.sum("count")).na.fill(0)

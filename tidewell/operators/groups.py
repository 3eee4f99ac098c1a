"""Groups of reads: depth, threshold codebooks, best rows, column votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import sized_broadcast
from . import matrices
from .numbering import dense_index
from .sampling import first_per_group


def depth_by(df: DataFrame, keys: Sequence[str], duplex: Column | None = None, prefix: str = "", suffix: str = "") -> DataFrame:
    """Rows per key, and rows that satisfy ``duplex`` where it is given (AGG2)."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}depth{suffix}")]
    if duplex is not None:
        aggs.append(F.sum(F.when(duplex, 1).otherwise(0)).cast("long").alias(f"{prefix}duplex_depth{suffix}"))
    return df.groupBy(*keys).agg(*aggs)


def with_depth(df: DataFrame, keys: Sequence[str], duplex: Column | None = None, prefix: str = "", suffix: str = "") -> DataFrame:
    """The rows with their key's depth beside them: aggregate, then join back, so no window holds wide rows."""
    return df.join(depth_by(df, keys, duplex, prefix, suffix), list(keys), "left")


def threshold_codebook(df: DataFrame, barcode: str, member: str, min_depth: int, index: str = "barcodeid") -> DataFrame:
    """Barcodes seen at least ``min_depth`` times, numbered from 0 in barcode order, with their sorted members (AGG1).
    The list of members is the table's own form; ``barcode_members`` gives the same as rows, for barcodes too frequent
    for one row."""
    deep = dense_index(depth_by(df, [barcode]).filter(F.col("depth") >= min_depth), [barcode], index)
    lists = df.groupBy(barcode).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return deep.join(lists, barcode).select(barcode, "depth", "members", index)


def barcode_members(df: DataFrame, barcode: str, member: str, min_depth: int, index: str = "barcodeid") -> DataFrame:
    """(barcodeid, member): the members of the barcodes seen at least ``min_depth`` times, a row each (AGG1)."""
    deep = dense_index(depth_by(df, [barcode]).filter(F.col("depth") >= min_depth), [barcode], index)
    return df.join(sized_broadcast(deep.select(barcode, index)), barcode).select(index, member)


def best_rows(df: DataFrame, group: Sequence[str], quality: str, n: int, tiebreak: Sequence[str], salt: int = 0) -> DataFrame:
    """The ``n`` rows of highest quality per group, nulls last (TOP1). With ``salt``, each group is first cut to its best
    ``n`` within that many parts, so one group's rows do not meet in one task."""
    order = [F.col(quality).desc_nulls_last(), *map(F.col, tiebreak)]
    rows = df
    if salt > 1:
        part = F.pmod(F.xxhash64(*tiebreak), F.lit(salt))
        inside = Window.partitionBy(*group, "_salt").orderBy(*order)
        rows = rows.withColumn("_salt", part).withColumn("_rank", F.row_number().over(inside)).filter(F.col("_rank") <= n).drop("_salt", "_rank")
    over = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= n)


def read_quality(df: DataFrame) -> Column:
    """What reads are ranked by: ``rq`` where the table has it, else ``qs``, else the mean of ``read_phred`` (TOP1)."""
    from .filters import mean_phred

    for c in ("rq", "qs"):
        if c in df.columns:
            return F.col(c)
    return mean_phred()


def limit_group_content(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], n: int) -> DataFrame:
    """Beyond the first ``n`` rows of a group the given columns become null; the rows stay (PRJ14). ``order`` tells the rows
    of a group apart. Only the order of each group's n-th row is found and put to the rows: no group meets in one task."""
    key = F.struct(*order)
    first = first_per_group(df.select(*group, *[c for c in order if c not in group]), group, order, n)
    last = first.groupBy(*group).agg(F.max(key).alias("_last")).select(*[F.col(g).alias(f"_own_{g}") for g in group], "_last")
    same = [F.col(g).eqNullSafe(F.col(f"_own_{g}")) for g in group]
    out = df.join(last, same, "left").withColumns({c: F.when(key <= F.col("_last"), F.col(c)) for c in columns})
    return out.drop("_last", *[f"_own_{g}" for g in group])


def column_vote(df: DataFrame, group: Sequence[str], seq: str, into: str = "consensus") -> DataFrame:
    """The majority base at every position, ties to the alphabet (AGG4). Tasks count into packed matrices of a thousand
    positions (``matrices``), which add up; groups without a base have no row."""
    blocks = matrices.over_matrices(matrices.count_matrices(df, group, seq), group, matrices.majority, "text string")
    joined = blocks.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    return joined.select(*group, F.array_join(F.col("parts.text"), "").alias(into))


def ambiguous_positions(df: DataFrame, group: Sequence[str], seq: str, share: float = 0.1, pseudo: float = 0.001) -> DataFrame:
    """Share of a group's positions whose second most frequent base is above ``share`` of the reads (AGG5)."""
    blocks = matrices.over_matrices(matrices.count_matrices(df, group, seq), group, matrices.ambiguous(share, pseudo), "places long, ambiguous long")
    return blocks.groupBy(*group).agg((F.sum("ambiguous") / F.sum("places")).alias("ambiguous_share"))


def consensus_per_group(df: DataFrame, group: str, func, schema: str, max_group: int, quality: str, name: str = "name") -> DataFrame:
    """A user's consensus over the best ``max_group`` reads of each group (AGG3, UDF1): ``func(pandas) -> dict`` of the
    schema's columns beside the group; a single read is handed over like any other. Bounded before Python sees it."""
    import pandas as pd

    best = best_rows(df.filter(F.col(group).isNotNull()), [group], quality, max_group, [name], salt=8).drop("rank")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{group: pdf[group].iloc[0], **func(pdf)}])

    kind = df.schema[group].dataType.simpleString()
    named = best.groupBy(group).agg(F.concat(F.lit("consensus_"), F.sha2(F.concat_ws("", F.array_sort(F.collect_list(name))), 256)).alias("consensus_name"))
    return best.groupBy(group).applyInPandas(run, f"{group} {kind}, {schema}").join(named, group)

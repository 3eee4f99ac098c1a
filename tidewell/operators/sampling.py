"""Limits and samples (TOP2, TOP3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, salt: int = 16) -> DataFrame:
    """The first ``n`` rows per group: a library's cap per target and mismatch (TOP2). Each group is first cut to its first
    ``n`` within ``salt`` parts, so one group's rows do not meet in one task."""
    rows = df
    if salt > 1:
        inside = Window.partitionBy(*group, "_salt").orderBy(*order)
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salt))).withColumn("_rank", F.row_number().over(inside)).filter(F.col("_rank") <= n).drop("_salt")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def sample_share(df: DataFrame, key: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """Rows whose key hashes into the share: the same rows every time, without a shuffle (TOP3)."""
    return df.filter(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def sample_n(df: DataFrame, key: Sequence[str], n: int, group: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, of all or of each group, by hash order (TOP3)."""
    h = F.xxhash64(*key, F.lit(seed))
    if not group:
        return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")
    return first_per_group(df.withColumn("_h", h), group, ["_h", *key], n).drop("_h")

"""User functions over groups, rows, partitions and vectors (UDF1-5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_groups(df: DataFrame, group: Sequence[str], func: Callable[[pd.DataFrame], dict], schema: str, *aggs: Column) -> DataFrame:
    """A function of each group's rows to a dict, beside built-in aggregates (UDF1). Bound the groups first."""
    kinds = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in group)
    out = df.groupBy(*group).applyInPandas(lambda pdf: pd.DataFrame([{**{g: pdf[g].iloc[0] for g in group}, **func(pdf)}]), f"{kinds}, {schema}")
    return out.join(df.groupBy(*group).agg(*aggs), list(group)) if aggs else out


def map_rows(df: DataFrame, columns: Sequence[str], func: Callable[..., dict], schema: str) -> DataFrame:
    """A function of row values to a dict, in Arrow batches, as columns beside the others (UDF2)."""

    @F.pandas_udf(schema)
    def run(*cols: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([func(*row) for row in zip(*cols)])

    return df.withColumn("_out", run(*[F.col(c) for c in columns])).select("*", "_out.*").drop("_out")


def measure_columns(df: DataFrame, columns: Sequence[str], func: Callable[[np.ndarray], float], suffix: str) -> DataFrame:
    """A measurement of each array column, one new column each (UDF3)."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else float(func(np.asarray(v))))

    return df.withColumns({f"{c}_{suffix}": run(F.col(c)) for c in columns})


def map_partitions(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function over batches of each partition, its schema known (UDF4)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(func, batches)

    return df.mapInPandas(run, schema)


def aggregate_vectors(df: DataFrame, group: Sequence[str], vector: str, func: Callable[[np.ndarray], Sequence[float]]) -> DataFrame:
    """A function over the stacked vectors of each group (UDF5, TSR5), in one call a group: only for groups known to be small.

    For medians, median_vectors spreads a group over its positions; for means, vector_mean combines before the shuffle.
    """

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> list:
        return [float(x) for x in func(np.stack(v.to_numpy()))]

    return df.groupBy(*group).agg(run(F.col(vector)).alias("aggregate"))


def median_vectors(df: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """The exact median at each position of a group's vectors, as ``aggregate`` (UDF5, TSR5). No group meets in one call."""
    values = df.select(*group, F.posexplode(vector).alias("_pos", "_x"))
    medians = values.groupBy(*group, "_pos").agg(F.percentile(F.col("_x").cast("double"), 0.5).alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_m")))
    return medians.groupBy(*group).agg(F.transform(ordered, lambda x: x["_m"]).alias("aggregate"))

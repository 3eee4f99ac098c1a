"""Every registered query of the library proper against its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidewell.plans import registry

NAMES = sorted(registry.queries())


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool) or "bool" in type(v).__name__:
            return str(float(v))
        try:
            return str(float(f"{float(v):.6g}")) if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{Path(sf_dir) / f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, duck):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0

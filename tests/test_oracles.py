"""Every query of the core against its DuckDB counterpart on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tracklattice.plans.catalogue import FLAGSHIP, ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def cells(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (bool, str)):
            return str(v)
        if isinstance(v, (int, float)):
            return repr(round(float(v), 8) + 0.0)
        return str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, tiny, name):
    got, want = QUERIES[name](spark, tiny).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES

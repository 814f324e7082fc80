"""Every catalogue query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from rasterloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = ["NULL" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, db, name):
    got = normal(catalog.QUERIES[name](spark, SF).toPandas())
    want = normal(db.sql(catalog.SQL[name]).df())
    pd.testing.assert_frame_equal(got, want)


def test_discover(spark):
    rows = catalog.QUERIES["discover_files"](spark, SF).collect()
    assert {r.stem for r in rows} >= {"part", "events"}
    assert all(r.ext == ".parquet" for r in rows)

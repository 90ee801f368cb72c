"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from checks import registry as checked

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = dict(checked.QUERIES), dict(checked.SQL)
MAY_BE_EMPTY = {"gate_winners", "time_align"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(df[c]) or pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rsi_14" in df.columns


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = canonical(QUERIES[name](spark, SF).toPandas())
    expect = canonical(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(expect.columns)
    assert len(got) == len(expect)
    assert len(got) or name in MAY_BE_EMPTY
    for c in got.columns:
        if pd.api.types.is_float_dtype(got[c]) and pd.api.types.is_float_dtype(expect[c]):
            np.testing.assert_allclose(got[c], expect[c], atol=2e-6, err_msg=c)
        else:
            assert [str(x) for x in got[c]] == [str(x) for x in expect[c]], c

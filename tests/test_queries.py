"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from docmeter.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)]
    number = lambda v: isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_))
    cell = lambda v: "NULL" if v is None or v is pd.NA or v is pd.NaT or v != v else repr(round(float(v), 5) + 0.0) if number(v) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""The registry, and every query with SQL against DuckDB at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: v for k, v in registry.queries().items() if not k.startswith("op") and k != "pipeline"}


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda x: "None" if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(text(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert registry.entry(spark).count() == 4


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, duck, name):
    got = OWN[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)

"""Every registered query with SQL against DuckDB on the smallest tables."""

import numbers

import duckdb
import pandas as pd
import pytest

from loomgraph.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return round(float(v), 6) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)


def rows(df):
    return sorted([tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_scan_reads_few_columns(spark, sf):
    plan = QUERIES["spoiler_view"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(turn,3)" in plan and "role" not in plan.split("ReadSchema")[1][:80]

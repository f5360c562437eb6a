"""Every query with SQL against DuckDB, and the contract of the entry module."""

from __future__ import annotations

import os

import duckdb
import pytest
from driftline.plans import registry

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(row):
    return tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_returns_what_its_sql_says(spark, tables, name):
    df = registry.queries()[name](spark, SF)
    want = tables.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    ours = sorted(map(repr, (plain(r) for r in df.select(*columns).collect())))
    assert ours == sorted(map(repr, (plain(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())))


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

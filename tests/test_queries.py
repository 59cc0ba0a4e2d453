"""Every registered query with SQL against DuckDB, and the contract of the entry points."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{folder}/{name}')")
    return con


def plain(rows):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(round(float(x), 9) + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, folder, duck, name):
    got, want = entry.queries()[name](spark, folder), duck.sql(ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(map(tuple, got.select(columns).collect())) == plain(want.select(*columns).fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", ["mf_als", "mf_sgd"])
def test_fitted(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() >= 1

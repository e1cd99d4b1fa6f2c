"""Every registered query against its oracle text on the smallest data set."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
from spotloom.catalog.core import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
# The training-data queries have tests of their own beside their subpackage.
NAMES = [n for n in QUERIES if not re.match(r"op[0-9]+_|pipeline$", n)]


# Jobs whose values depend on how the data fall are compared on the larger tables too.
LARGER = "/root/testdata/sf0.01"
JOBS = [n for n in NAMES if n in ORACLES and re.match(r"job_0[4-9]|agg_07|joi_0[89]|joi_10", n)]


def connected(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.fixture(scope="module")
def larger_duck():
    return connected(LARGER)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", JOBS)
def test_query_on_larger_tables(spark, larger_duck, name):
    compare(spark, larger_duck, name, LARGER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    compare(spark, duck, name, SF)


def compare(spark, duck, name, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0

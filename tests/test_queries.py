"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "lineitem", "benchmark", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", list(contract.CATALOG))
def test_query_matches_its_sql(spark, db, name):
    frame = contract.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = db.execute(contract.oracle_sql()[name])
    heads = [d[0] for d in result.description]
    assert sorted(heads) == columns
    rows = result.fetchall()
    assert got and got == sorted((tuple(r[heads.index(c)] for c in columns) for r in rows), key=repr)


def test_entry(spark):
    assert contract.entry(spark).count() > 0

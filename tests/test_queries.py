"""Every registered query against its reference SQL on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.plans import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        if name.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0).removesuffix(".0")
    return str(value)


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    cursor = db.execute(ORACLE[name])
    theirs_columns = [c[0] for c in cursor.description]
    assert sorted(theirs_columns) == columns
    order = [theirs_columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

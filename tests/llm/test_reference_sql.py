"""Queries that SQL can express, against DuckDB on given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.llm.reference_sql import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    db = duckdb.connect()
    for table in os.listdir(SF_DIR):
        if table.endswith(".parquet"):
            db.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{SF_DIR}/{table}'")
    frame = entry.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)

    def plain(value):
        return round(value, 5) + 0.0 if isinstance(value, float) else value

    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=str)

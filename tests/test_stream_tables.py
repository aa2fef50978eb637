"""Streams over tables that are one file, a folder of files, or empty."""

import duckdb
import pytest

from pagewright.plans import export_queries as X
from pagewright.sources.pages import PAGE_SCHEMA

PAGE = '<html lang="en"><head><title>Page {0}</title></head><body><article><p>Words of page {0}.</p><a href="/t/{0}">to {0}</a></article></body></html>'
STREAMS = ["streamed_records", "streamed_links", "streamed_distinct", "streamed_json"]


def stored(spark, rows, folder, files):
    spark.createDataFrame(rows, PAGE_SCHEMA).repartition(files).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def as_file(rows, folder):
    folder.mkdir()
    values = ", ".join(f"({i}::BIGINT, '{u}', '{h}')" for i, u, h in rows)
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) AS t(page_id, url, html)) TO '{folder}/pages.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", STREAMS)
def test_a_table_in_a_folder_streams_as_one_in_a_file(spark, tmp_path, name):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(7)] + [(7, "http://a.example/1#x", PAGE.format(1))]
    query = X.QUERIES[name]
    whole = sorted(map(str, query(spark, as_file(rows, tmp_path / "file")).collect()))
    parts = sorted(map(str, query(spark, stored(spark, rows, tmp_path / "parts", 3)).collect()))
    assert whole == parts and len(whole) == {"streamed_distinct": 7}.get(name, 8)


@pytest.mark.parametrize("name", STREAMS[:3])
def test_a_stream_without_rows_has_no_rows(spark, tmp_path, name):
    folder = tmp_path / "none"
    (folder / "pages.parquet").mkdir(parents=True)
    found = X.QUERIES[name](spark, str(folder))
    assert found.columns and found.count() == 0

"""What a page's arrays are computed from must run once per page."""

import pytest

from pagewright.plans import page_queries as Q
from pagewright.sources.pages import PAGE_SCHEMA

HTML = ("<html><body><h1>Head</h1><article>" + "".join(f"<p>Paragraph number {i} with some words</p>" for i in range(5))
        + "<ul><li>one</li><li>two</li></ul></article></body></html>")


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(1, "http://a/1", HTML), (2, "http://a/2", "<p>short</p>"), (3, "http://a/3", None), (4, None, HTML), (None, "http://a/5", HTML)]
    spark.createDataFrame(rows, PAGE_SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, rows", [("headings", 3), ("paragraphs", 15), ("lists", 6), ("images", 3), ("kept_elements", None), ("content_scores", 3)])
def test_arrays_are_not_built_again(spark, folder, name, rows):
    found = Q.QUERIES[name](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(transform(" not in plan  # the strings of the page, stripped for every element
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]  # the array a second time, for its size
    assert rows is None or found.count() == rows

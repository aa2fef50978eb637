import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def page(spark):
    """Parse one or more html texts: page_id counts from 1, url is shared unless given."""
    from pagewright.sources.parse import parse_pages

    def build(*htmls, url="https://example.com/dir/page", keep_html=False):
        rows = [(i, url, h) for i, h in enumerate(htmls, 1)]
        frame = spark.createDataFrame(rows, "page_id long, url string, html string")
        return parse_pages(frame, keep_html=keep_html)

    return build

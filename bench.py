"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS the cores.  Each
query runs twice and the faster run counts: the first run also pays for code generation.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from pagewright.plans import QUERIES  # noqa: E402
from pagewright.plans.page_queries import parsed  # noqa: E402

HEADLINE = [
    "element_counts", "page_extract", "page_record", "link_table", "links_per_host", "unique_urls",
    "fetch_outcomes", "crawl_pages", "bounded_crawl_orders", "budget_crawl", "politeness_schedule", "numbered_turns",
    "export_stats", "link_prompts", "content_responses", "link_scores", "merged_annotations", "csv_round_trip",
    "jsonl_round_trip", "markdown_file", "streamed_records", "streamed_counters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    timings = {}

    def timed(name, query):
        best = None
        for _ in range(2):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)

    timed("parse", parsed)
    for name in wanted:
        timed(name, QUERIES[name])
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(os.path.normpath(sf_dir)),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

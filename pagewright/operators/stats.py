"""Crawl and export statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import duration_text, duration_text_1, percent_text
from pagewright.functions.urls import netloc


def crawl_stats(visited: DataFrame, by: list[str] = ("seed",), mode: str = "table") -> DataFrame:
    """A1: pages scraped, URLs processed, failures and success rate per crawl.

    Without `by` the result is one row for the whole table, '0%' when it is empty.
    """
    counted = visited.groupBy(*by).agg(
        F.count(F.when(F.col("ok"), 1)).alias("total_pages_scraped"),
        F.count(F.lit(1)).alias("total_urls_processed"))
    rate = percent_text("total_pages_scraped", "total_urls_processed")
    return counted.selectExpr(
        *by, "total_pages_scraped", "total_urls_processed",
        "total_urls_processed - total_pages_scraped AS failed_urls",
        f"if(total_urls_processed = 0, '0%', {rate}) AS success_rate", f"'{mode}' AS fetch_mode")


def bounded_stats(visited: DataFrame, by: list[str] = ("seed",), duration: str = "0D") -> DataFrame:
    """A2: as A1, but only successes count as visited, so the rate is 100 % or '0%'."""
    counted = visited.groupBy(*by).agg(
        F.count(F.when(F.col("ok"), 1)).alias("total_pages_scraped"),
        F.count(F.when(~F.col("ok"), 1)).alias("failed_urls"))
    rate = percent_text("total_pages_scraped", "total_pages_scraped")
    return counted.selectExpr(
        *by, "total_pages_scraped", "total_pages_scraped AS total_urls_visited", "failed_urls",
        f"cast(bround({duration}, 2) as double) AS duration_seconds",
        f"{duration_text(duration)} AS duration_formatted",
        f"if(total_pages_scraped = 0, '0%', {rate}) AS success_rate")


def to_export_stats(stats: DataFrame, start_url: str = "seed") -> DataFrame:
    """A4: the statistics of a bounded crawl in the export layout."""
    found = stats.selectExpr(
        "total_urls_visited AS total_pages", "total_pages_scraped AS successful_pages",
        "failed_urls AS failed_pages", f"{start_url} AS start_url",
        f"{netloc(start_url)} AS domain", "duration_seconds")
    return complete_stats(found)


def export_stats(pages: DataFrame, by: list[str], links: DataFrame | None = None,
                 ok: str = "ok", load_time: str = "0D", size: str = "0L") -> DataFrame:
    """A3: the export statistics per group, with those metrics the tables can give.

    `links` adds the links found and followed per group.
    """
    counted = pages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count(F.when(F.expr(ok), 1)).alias("successful_pages"),
        F.count(F.when(~F.expr(ok), 1)).alias("failed_pages"),
        F.avg(F.expr(load_time)).alias("avg_load_time_ms"),
        F.sum(F.expr(size)).alias("total_bytes_downloaded"))
    if links is not None:
        found = links.groupBy(*by).agg(
            F.count(F.lit(1)).alias("total_links_found"),
            F.count(F.when(F.col("follow"), 1)).alias("total_links_followed"))
        counted = counted.join(found, by, "left").fillna(0, ["total_links_found", "total_links_followed"])
    return complete_stats(counted, by)


def complete_stats(stats: DataFrame, by: list[str] = ()) -> DataFrame:
    """The 16 columns of an export statistic; what is not known gets its default."""
    defaults = {
        "total_pages": "0L", "successful_pages": "0L", "failed_pages": "0L",
        "success_rate": percent_text("successful_pages", "total_pages"),
        "total_links_found": "0L", "total_links_followed": "0L", "start_time": "''", "end_time": "''",
        "duration_seconds": "0D", "duration_formatted": None, "start_url": "''", "domain": "''",
        "avg_load_time_ms": "0D", "total_bytes_downloaded": "0L",
        "llm_provider": "cast(null as string)", "llm_calls": "0L",
    }
    known = {c: c for c in stats.columns}
    duration = known.get("duration_seconds", defaults["duration_seconds"])
    defaults["duration_formatted"] = duration_text_1(duration)
    return stats.selectExpr(
        *[c for c in by if c not in defaults],
        *[f"{known.get(name, default)} AS {name}" for name, default in defaults.items()])

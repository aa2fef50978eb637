"""The page operators on streams: the same transforms, plus what needs state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions.urls import netloc, normalize_url
from pagewright.operators.content import extract_pages
from pagewright.operators.links import extract_links
from pagewright.sinks.rows import json_line
from pagewright.sources.pages import PAGE_SCHEMA, read_pages
from pagewright.sources.parse import parse_pages


def stream_pages(spark: SparkSession, path: str, schema: T.StructType = PAGE_SCHEMA) -> DataFrame:
    """Pages as their files arrive."""
    return read_pages(spark, path, streaming=True, schema=schema)


def stream_records(pages: DataFrame, **settings) -> DataFrame:
    """Page records of a stream; stateless, so batches and streams agree."""
    return extract_pages(parse_pages(pages), **settings)


def stream_links(pages: DataFrame, **settings) -> DataFrame:
    """The link table of a stream."""
    return extract_links(parse_pages(pages), **settings)


def dedup_stream(pages: DataFrame, watermark: str | None = None, event_time: str = "fetched_at") -> DataFrame:
    """Keep the first arrival of each normalised URL.

    Without a watermark every URL stays in state for good.  With one, state is dropped
    once the watermark has passed, so an endless stream needs bounded memory.
    """
    keyed = pages.withColumn("url_norm", F.expr(f"coalesce({normalize_url('url')}, url)"))
    if watermark is None:
        return keyed.dropDuplicates(["url_norm"])
    timed = keyed.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["url_norm"])


def running_counters(pages: DataFrame, ok: str = "true", by: str | None = None) -> DataFrame:
    """Pages, successes and failures so far, per host; for output mode update or complete."""
    return pages.withColumn("host", F.expr(by or netloc("url"))).groupBy("host").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count(F.when(F.expr(ok), 1)).alias("scraped"),
        F.count(F.when(~F.expr(ok), 1)).alias("failed"))


def stream_save(results: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """T4, K3: append results as JSON lines, exactly once per row.

    `checkpoint` must be in storage that outlives the cluster.
    """
    writer = json_line(results).writeStream.format("text").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()

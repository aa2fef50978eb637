"""Page sources and the filters in front of the parse job."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.core import regex

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# Phrases of interstitial pages.
CHALLENGE_PHRASES = [
    "Checking your browser",
    "Please Wait",
    "Just a moment",
    "Attention Required",
    "cf-browser-verification",
    "cf-challenge",
]


def read_pages(spark: SparkSession, path: str, streaming: bool = False,
               schema: T.StructType = PAGE_SCHEMA) -> DataFrame:
    """The table of fetched pages, as a batch or as a stream of new files."""
    if streaming:
        return spark.readStream.schema(schema).parquet(path)
    return spread(spark.read.parquet(path))


def spread(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Give the parse job enough partitions.

    A table of many files already has them and is read as it is; only a table with
    fewer splits than the session has cores is redistributed.
    """
    wanted = partitions or pages.sparkSession.sparkContext.defaultParallelism
    return pages if pages.rdd.getNumPartitions() >= wanted else pages.repartition(wanted)


def document_kind(url: str = "url", content_type: str | None = None, html: str | None = None) -> Column:
    """S2: 'xml' or 'html'.

    With `html`, the rule for pages saved from a browser applies: the address ends in
    .xml in any case, or the text starts with an XML declaration.
    """
    if html is not None:
        leading = r"^(?U)[\s\x1c-\x1f]*<\?xml"
        is_xml = F.expr(f"endswith(lower({url}), '.xml') or coalesce({html} rlike {regex(leading)}, false)")
    else:
        is_xml = F.expr(f"endswith({url}, '.xml')")
        if content_type is not None:
            is_xml = F.expr(f"contains(lower(coalesce({content_type}, '')), 'xml')") | is_xml
    return F.when(is_xml, "xml").otherwise("html")


def drop_challenge_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Drop stored pages that only show a browser check.

    The title is part of the html, so one scan of the html covers both.
    """
    phrases = "|".join(re.escape(p) for p in CHALLENGE_PHRASES)
    return pages.filter(f"not coalesce({html_col} rlike {regex('(?i)' + phrases)}, false)")


def ok_status(attempts: DataFrame, strict: bool = False, status_col: str = "status") -> DataFrame:
    """Status below 400, or exactly 200 when strict."""
    return attempts.filter(F.col(status_col) == 200 if strict else F.col(status_col) < 400)


def fetch_outcomes(attempts: DataFrame, max_retries: int = 3, key: str = "url",
                   order: str = "attempt", ok: str = "status < 400",
                   payload: list[str] | None = None) -> DataFrame:
    """One row per key: the first success within the first `max_retries` attempts.

    Columns: key, ``attempts_made``, ``succeeded`` and the payload of that success.  The
    first attempts are found by a grouped limit, so a key with very many attempts
    sends at most `max_retries` rows per task through the shuffle.
    """
    carried = payload or []
    window = f"row_number() OVER (PARTITION BY {key} ORDER BY {order})"
    tried = attempts.selectExpr(key, *carried, f"({ok}) AS _ok", f"{window} AS _n").filter(
        F.col("_n") <= max_retries)
    first_ok = F.min(F.when(F.col("_ok"), F.struct("_n", *carried)))
    return (
        tried.groupBy(key)
        .agg(F.max("_n").alias("_tried"), first_ok.alias("_first"))
        .select(key, F.coalesce("_first._n", "_tried").alias("attempts_made"),
                F.col("_first").isNotNull().alias("succeeded"),
                *[F.col(f"_first.{c}").alias(c) for c in carried])
    )

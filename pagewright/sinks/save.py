"""Writing results: one distributed writer job per output.

An export is a folder.  Rows are written by all tasks; what belongs to the document as
a whole (metadata, statistics, titles) is a file of its own next to them.  Nothing is
collected.  The folders of a Markdown report and of a JSON document are numbered: their files, read in the
order of their names, are the report or document.  An export becomes visible as a whole, by one rename.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagewright.operators.ordering import in_order
from pagewright.session import scratch_folder
from pagewright.sinks import rows as R
from pagewright.sinks.commit import Folders, one_commit

# Format names and the file extensions that stand for them.
FORMATS = {
    "json": ".json", "jsonl": ".jsonl", "markdown": ".md", "markdown-single": ".md",
    "csv": ".csv", "tsv": ".tsv", "csv-flat": ".csv",
}
EXTENSIONS = {
    "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "md": "markdown", "markdown": "markdown",
    "csv": "csv", "tsv": "tsv",
}


@dataclass
class ExportOptions:
    """Settings of an export.  `pretty_print` indents the records of a JSON export; it is off
    by default, so that every line is a record and tasks can split the files."""

    pretty_print: bool = False
    #: JSON as one document {metadata, stats, data} instead of a folder for each
    document: bool = False
    include_metadata: bool = True
    include_stats: bool = True
    include_raw_html: bool = False
    include_links: bool = True
    include_images: bool = False
    max_content_length: int | None = None
    delimiter: str = ","
    include_toc: bool = True
    heading_level: int = 2
    columns: list[str] | None = None


def format_for_extension(extension: str) -> str:
    """The format of a file extension; unknown extensions mean JSON."""
    return EXTENSIONS.get(extension.lower().lstrip("."), "json")


def check_format(name: str) -> str:
    """Format names are case-insensitive; an unknown name is an error."""
    if name.lower() not in FORMATS:
        raise ValueError(f"Unknown export format: {name}. Available: {list(FORMATS)}")
    return name.lower()


def with_extension(path: str, format_name: str) -> str:
    """Add the extension of the format when the path has none."""
    return path if os.path.splitext(path)[1] else path + FORMATS[format_name]


def save(results: DataFrame, path: str, format: str | None = None, stats: DataFrame | None = None,
         options: ExportOptions | None = None) -> str:
    """Write results in one of seven formats and return the path written."""
    chosen = check_format(format) if format else format_for_extension(os.path.splitext(path)[1])
    target = with_extension(path, chosen)
    options = options or ExportOptions()
    shown = stats if options.include_stats else None
    writer = {
        "json": _save_json, "jsonl": _save_jsonl, "markdown": _save_markdown,
        "markdown-single": _save_single, "csv": _save_csv, "tsv": _save_csv, "csv-flat": _save_flat,
    }[chosen]
    if chosen == "tsv":
        options = replace(options, delimiter="\t")
    with one_commit(results.sparkSession, target) as staging:
        writer(results, staging, shown, options)
    return target


def _filtered(results, options):
    return R.filter_fields(results, options.include_raw_html, options.include_links,
                           options.include_images, options.max_content_length)


def _write_lines(lines: DataFrame, path: str) -> int:
    """Write the lines and return how many there were, as the write itself counted them."""
    seen = Observation()
    lines.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def _metadata(total: int, results: DataFrame, format_name: str, **extra) -> DataFrame:
    """One row."""
    now = datetime.now(timezone.utc).replace(tzinfo=None).isoformat() + "Z"
    return results.sparkSession.range(1).select(
        *[F.lit(v).alias(k) for k, v in extra.items() if k == "_type"],
        F.lit(now).alias("exported_at"), F.lit(format_name).alias("format"),
        *[F.lit(v).alias(k) for k, v in extra.items() if k != "_type"], F.lit(total).cast("long").alias("total_results"))


def _save_json(results, path, stats, options):
    if options.document:
        _save_document(results, path, stats, options)
        return
    total = _write_lines(R.json_line(_filtered(results, options), pretty=options.pretty_print), f"{path}/data")
    if options.include_metadata:
        _metadata(total, results, "json", version="1.0").write.mode("overwrite").json(f"{path}/metadata")
    if stats is not None:
        stats.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/stats")


def _save_document(results, path, stats, options):
    """K2, K3: files whose contents, in the order of their names, are one JSON document.

    Every record is written by the task that has it, after a line with a comma; only the first record of all has none
    before it, and its file is written again without.  So `spark.read.json` in mode
    DROPMALFORMED finds the records of the same files in parallel.
    """
    spark = results.sparkSession
    if stats is not None and stats.limit(2).count() > 1:
        raise ValueError("a JSON document has the statistics of one crawl; save several as folders")
    lines = R.json_line(_filtered(results, options), pretty=options.pretty_print)
    total = _write_lines(lines.select(F.concat(F.lit(",\n"), F.col("value"))), f"{path}/3-data")
    folders = Folders(spark, path)
    first = next((name for name, size in folders.files(f"{path}/3-data") if size), None)
    if first is not None:
        # A file of one task: its first line is the comma.
        rows = spark.read.text(first).withColumn("_id", F.monotonically_increasing_id())
        rows.where("_id <> 0").select("value").write.text(f"{path}/2-first")
        folders.delete(first)
    kept = {"ignoreNullFields": "false"}
    head = spark.range(1).select(F.lit("{").alias("head"))
    if options.include_metadata:
        described = _metadata(total, results, "json", version="1.0").select(F.to_json(F.struct("*"), kept).alias("metadata"))
        head = head.crossJoin(described).select(F.concat("head", F.lit('"metadata":'), "metadata", F.lit(",\n")).alias("head"))
    if stats is not None:
        stated = stats.select(F.to_json(F.struct("*"), kept).alias("stats")).agg(F.max("stats").alias("stats"))
        head = head.crossJoin(stated).select(F.concat("head", F.lit('"stats":'), F.coalesce("stats", F.lit("{}")), F.lit(",\n")).alias("head"))
    head.select(F.concat("head", F.lit('"data":['))).write.text(f"{path}/1-head")
    spark.range(1).select(F.lit("]}")).write.text(f"{path}/4-tail")


def _save_jsonl(results, path, stats, options):
    keep_nulls = {"ignoreNullFields": "false"}
    total = _write_lines(R.json_line(_filtered(results, options), "result"), path)
    if options.include_metadata:
        _metadata(total, results, "jsonl", _type="metadata").select(
            F.to_json(F.struct("*"), keep_nulls)).write.mode("append").text(path)
    if stats is not None:
        stats.select(F.to_json(F.struct("*", F.lit("stats").alias("_type")), keep_nulls)).write.mode(
            "append").text(path)


def _write_cells(cells: DataFrame, path: str, delimiter: str) -> None:
    cells.write.mode("overwrite").csv(
        path, sep=delimiter, header=True, quoteAll=True, escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _save_csv(results, path, stats, options):
    cells = R.csv_row(results, options.columns, options.max_content_length)
    if stats is None:
        _write_cells(cells, path, options.delimiter)
        return
    # The lines of a crawl are one value, so they stay together however many crawls there are.
    R.stats_preamble_text(stats, options.delimiter).write.mode("overwrite").text(f"{path}/stats")
    _write_cells(cells, f"{path}/data", options.delimiter)


def _save_flat(results, path, stats, options):
    # Columns come from the rows, so these are read twice: computed once.
    staged = scratch_folder(results.sparkSession, "flat")
    results.write.parquet(staged)
    results = results.sparkSession.read.schema(results.schema).parquet(staged)
    found = R.discover_columns(results)
    if not found["rows"]:
        # No results: an empty export, without a header.
        results.sparkSession.createDataFrame([], "value string").write.mode("overwrite").text(path)
        return
    _write_cells(R.flatten(results, found), path, options.delimiter)


def _save_markdown(results, path, stats, options):
    # One range sort numbers the pages; contents and pages are written block by block in that order.
    pages = R.numbered(results, keep_block=True)
    head = "# Web Scraping Results\n"
    if options.include_metadata:
        now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")
        head += f"\n## Export Information\n\n- **Exported at:** {now}\n- **Format:** Markdown\n\n---\n"
    one_row = results.sparkSession.range(1)
    one_row.select(F.lit(head)).write.mode("overwrite").text(f"{path}/0-head")
    if stats is not None:
        R.stats_table(stats).write.mode("overwrite").text(f"{path}/1-stats")
    ordered = in_order(pages)
    # A table of contents is only written for more than one page.
    has_contents = options.include_toc and pages.limit(2).count() > 1
    if has_contents:
        R.contents_line(ordered).select(F.concat(
            F.when(F.col("number") == 1, "## Table of Contents\n\n").otherwise(""), "line")).write.mode(
            "overwrite").text(f"{path}/2-contents")
    rule = "\n---\n\n" if has_contents else ""
    one_row.select(F.lit(rule + "## Pages\n")).write.mode("overwrite").text(f"{path}/3-heading")
    R.markdown_page(ordered, options.heading_level, options.include_links, options.max_content_length).select(
        "markdown").write.mode("overwrite").text(f"{path}/4-pages")


def _save_single(results, path, stats, options):
    order = [c for c in ("page_id", "url") if c in results.columns]
    first = R.single_page_markdown(results.orderBy(*order).limit(1)).select("markdown")
    none = "# No Results\n\nNo pages were scraped."
    # max over at most one row gives the text, or null when there is no result
    first.agg(F.coalesce(F.max("markdown"), F.lit(none)).alias("value")).write.mode("overwrite").text(path)


def save_with_stats(pages: DataFrame, stats: DataFrame, path: str) -> str:
    """One record per URL under ``data`` and the statistics under ``stats``."""
    record = [c for c in pages.columns if c not in ("url", "page_id")]
    pages.select("url", F.struct(*record).alias("record")).write.mode("overwrite").option(
        "ignoreNullFields", "false").json(f"{path}/data")
    stats.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/stats")
    return path

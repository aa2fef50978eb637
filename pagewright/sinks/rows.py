"""Export rows: what each format writes, as columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.core import let, non_empty, quote, transform, truncate
from pagewright.functions.text import for_export, join_entries, join_values, page_anchor, percent_text
from pagewright.operators.ordering import number_rows

# The columns of an export row, in order.
RESULT_COLUMNS = [
    "url", "title", "content", "meta_description", "headings", "links", "images", "summary",
    "topics", "content_type", "scraped_at", "load_time_ms", "status_code",
]
# The columns of a CSV export, in order.
CSV_COLUMNS = [
    "url", "title", "meta_description", "content", "summary",
    "content_type", "topics", "status_code", "load_time_ms", "scraped_at",
]
OPTIONAL_COLUMNS = ["raw_html", "llm_analysis"]


def _is_map_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.MapType)


def _result_columns(results: DataFrame) -> list[str]:
    return [c for c in RESULT_COLUMNS + OPTIONAL_COLUMNS if c in results.columns]


def filter_fields(results: DataFrame, include_raw_html: bool = False, include_links: bool = True,
                  include_images: bool = False, max_content_length: int | None = None) -> DataFrame:
    """K1: drop the fields an export leaves out and cut the content."""
    dropped = {"raw_html": not include_raw_html, "links": not include_links, "images": not include_images}
    kept = results.drop(*[c for c, drop in dropped.items() if drop])
    if max_content_length and "content" in kept.columns:
        kept = kept.withColumn("content", F.expr(truncate("content", max_content_length)))
    return kept


def _is_filled(results: DataFrame, column: str) -> str:
    kind = results.schema[column].dataType
    if isinstance(kind, T.StringType):
        return f"coalesce({column} <> '', false)"
    if isinstance(kind, T.MapType):
        return f"coalesce(size({column}) > 0, false)"
    return f"{column} is not null"


def json_line(results: DataFrame, kind: str | None = None, pretty: bool = False) -> DataFrame:
    """K2-K4: each row as one JSON text, nulls included; optional fields only when filled.

    `kind` adds ``_type``."""
    columns = [c for c in results.columns if c in RESULT_COLUMNS]
    optional = [c for c in OPTIONAL_COLUMNS if c in results.columns]
    tail = [F.lit(kind).alias("_type")] if kind else []
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    value = F.to_json(F.struct(*columns, *tail), options)
    # Larger sets of filled fields come later and are therefore tested first.
    for size in range(1, len(optional) + 1):
        for chosen in combinations(optional, size):
            filled = F.expr(" and ".join(_is_filled(results, c) for c in chosen))
            value = F.when(filled, F.to_json(F.struct(*columns, *chosen, *tail), options)).otherwise(value)
    return results.select(value.alias("value"))


#: Most columns of a flat export that come from the data
MAX_FLAT_COLUMNS = 10_000


def _first(array: str, n: int | None) -> str:
    return array if n is None else f"slice({array}, 1, {int(n)})"


def _csv_cell(results: DataFrame, column: str, max_links: int | None) -> str:
    kind = results.schema[column].dataType
    if _is_map_list(kind):
        # The first entries, by their url.
        return join_values(transform(_first(column, max_links), lambda x: f"coalesce({x}['url'], to_json({x}))"))
    if isinstance(kind, T.ArrayType):
        return join_values(f"cast({column} as array<string>)")
    if isinstance(kind, T.MapType):
        nested = isinstance(kind.valueType, T.ArrayType)
        listed = f"transform_values({column}, (k, v) -> {_python_list('v')})" if nested else column
        return join_entries(listed)
    return f"coalesce(cast({column} as string), '')"


def _python_list(values: str) -> str:
    """A list inside a map cell, written ['a', 'b']."""
    return f"concat('[', array_join(transform({values}, w -> concat('\\'', w, '\\'')), ', '), ']')"


def csv_row(results: DataFrame, columns: list[str] | None = None,
            max_content_length: int | None = None, max_links: int | None = 5) -> DataFrame:
    """The cells of a CSV or TSV export, all text; unknown columns are empty.

    W6: a cell names the first `max_links` links, or all.
    """
    def cell(column):
        value = _csv_cell(results, column, max_links) if column in results.columns else "''"
        if column == "content" and max_content_length:
            value = truncate(value, max_content_length)
        return f"{value} AS {column}"

    return results.selectExpr(*[cell(c) for c in columns or CSV_COLUMNS])


def discover_columns(results: DataFrame) -> dict[str, list[str]]:
    """The columns of a flat export that depend on the data.

    One pass: every row states what it has, and equal statements are combined before they are
    shuffled.  More than `MAX_FLAT_COLUMNS` of them are an error, not a wide table.
    """
    lists = [c for c in _result_columns(results) if _is_map_list(results.schema[c].dataType)]
    maps = [c for c in _result_columns(results) if isinstance(results.schema[c].dataType, T.MapType)]
    optional = [c for c in OPTIONAL_COLUMNS if c in results.columns]

    def states(kind, column, names, condition="true"):
        return f"if({condition}, transform({names}, n -> struct('{kind}' AS kind, '{column}' AS col, n AS name)), array())"

    stated = [states("rows", "rows", "array('rows')")]
    stated += [states("list", c, f"array('{c}_count')", f"size({c}) > 0") for c in lists]
    stated += [states("list", c, f"array('{c}')", f"size({c}) = 0") for c in lists]
    stated += [states("map", c, f"map_keys({c})", f"{c} IS NOT NULL") for c in maps]
    stated += [states("some", c, f"array('{c}')", f"{c} IS NOT NULL") for c in optional]
    seen = results.selectExpr(f"inline(concat({', '.join(stated)}))").distinct().limit(MAX_FLAT_COLUMNS + 1).collect()
    if len(seen) > MAX_FLAT_COLUMNS:
        raise ValueError(f"a flat export of these results has more than {MAX_FLAT_COLUMNS} columns")
    found = {name: [] for name in ["rows", *lists, *maps, *(c for c in optional if c == "raw_html")]}
    for row in sorted(seen):
        if row.col in found and row.kind != "some" or row.col == "raw_html":
            found[row.col].append(row.name)
    return found


def flatten(results: DataFrame, found: dict[str, list[str]] | None = None) -> DataFrame:
    """Every field as a text column, nested keys joined by ``_``, columns sorted.

    `found` comes from `discover_columns`, which is asked when it is not given.
    """
    found = found or discover_columns(results)
    cells = {}
    for c in _result_columns(results):
        kind = results.schema[c].dataType
        if _is_map_list(kind):
            both = {c: "''", f"{c}_count": f"if(size({c}) > 0, cast(size({c}) as string), '')"}
            cells |= {name: both[name] for name in found[c]}
        elif isinstance(kind, T.MapType):
            for key in found[c]:
                value = f"{c}[{quote(key)}]"
                text = join_values(value) if isinstance(kind.valueType, T.ArrayType) else f"coalesce({value}, '')"
                cells[f"{c}_{key}"] = text
        elif isinstance(kind, T.ArrayType):
            cells[c] = join_values(f"cast({c} as array<string>)")
        elif c not in found or found[c]:
            missing = "''" if c in OPTIONAL_COLUMNS else "'None'"
            cells[c] = f"coalesce(cast({c} as string), {missing})"
    return results.selectExpr(*[f"{cells[name]} AS `{name}`" for name in sorted(cells)])


def numbered(results: DataFrame, order: list | None = None, keep_block: bool = False) -> DataFrame:
    """Results with their 1-based ``number`` in the report."""
    keys = order or [c for c in ("page_id", "url") if c in results.columns]
    return number_rows(results, keys, "number", costly=True, keep_block=keep_block)


def page_title(title: str = "title", number: str = "number") -> str:
    return f"coalesce(nullif({title}, ''), concat('Page ', {number}))"


def markdown_page(numbered_results: DataFrame, heading_level: int = 2, include_links: bool = True,
                  max_content_length: int | None = None, max_headings: int | None = 5, max_links: int | None = 10,
                  max_link_text: int | None = 50) -> DataFrame:
    """The Markdown section of each page as a column.

    Headings per level, links and link texts are cut to the given numbers, or whole.
    """
    titled = numbered_results.withColumn("_title", F.expr(page_title()))
    heading_lines = (
        "flatten(transform(array_sort(map_entries(headings)), e -> transform("
        f"{_first('e.value', max_headings)}, "
        "h -> concat('- **', upper(e.key), ':** ', h))))")
    link_lines = transform(_first("links", max_links), lambda x: (
        f"concat('- [', coalesce({non_empty(truncate(f'coalesce({x}[{chr(39)}text{chr(39)}], {chr(39)}{chr(39)})', max_link_text))}, "
        f"'No text'), '](', coalesce({x}['url'], ''), ')')"))
    no_lines = "cast(array() as array<string>)"
    # The titles of the sections.
    sections = [
        f"concat('<a id=\"', {page_anchor('_title', 'number')}, '\"></a>')",
        f"concat('{'#' * heading_level} ', number, '. ', _title, '\\n')",
        "concat('**URL:** [', url, '](', url, ')\\n')",
        "concat('**Description:** ', nullif(meta_description, ''), '\\n')",
        "concat('**Topics:** ', nullif(array_join(topics, ', '), ''), '\\n')",
        "if(content_type <> 'unknown', concat('**Content Type:** ', content_type, '\\n'), null)",
        "concat('\\n### Summary\\n\\n', nullif(summary, ''), '\\n')",
        f"if(content <> '', concat('\\n### Content\\n\\n', {for_export('content', max_content_length)}, '\\n'), null)",
        f"if(size(headings) > 0, concat(array('\\n### Page Headings\\n'), {heading_lines}, array('')), {no_lines})",
    ]
    if include_links:
        more = no_lines if max_links is None else (
            f"if(size(links) > {max_links}, array(concat('\\n*... and ', size(links) - {max_links}, ' more links*')), {no_lines})")
        sections.append(f"if(size(links) > 0, concat(array('\\n### Links Found\\n'), {link_lines}, {more}, "
                        f"array('')), {no_lines})")
    sections.append("'\\n---\\n'")
    return titled.withColumn("markdown", F.expr("concat_ws('\\n', " + ", ".join(sections) + ")")).drop("_title")


def contents_line(numbered_results: DataFrame) -> DataFrame:
    """The line of each page in the table of contents."""
    return numbered_results.withColumn("_title", F.expr(page_title())).selectExpr(
        "number", f"concat(number, '. [', _title, '](#', {page_anchor('_title', 'number')}, ')') AS line")


def single_page_markdown(results: DataFrame) -> DataFrame:
    """Each page as an article of its own."""
    parts = ("array_compact(array(if(content_type <> 'unknown', concat('Type: ', content_type), null), "
             "concat('Topics: ', nullif(array_join(topics, ', '), ''))))")
    sections = [
        "concat('# ', coalesce(nullif(title, ''), 'Untitled Page'), '\\n')",
        "concat('> Source: [', url, '](', url, ')\\n')",
        let(parts, lambda p: f"if(size({p}) > 0, concat('*', array_join({p}, ' | '), '*\\n'), null)"),
        "concat('## Summary\\n\\n', nullif(summary, ''), '\\n')",
        "concat('## Content\\n\\n', nullif(content, ''))",
    ]
    return results.withColumn("markdown", F.expr("concat_ws('\\n', " + ", ".join(sections) + ")"))


def stats_table(stats: DataFrame) -> DataFrame:
    """K9: the statistics section of a report, one text per row of `stats`."""
    # The labels of the section.
    rows = [("Total Pages", "total_pages"), ("Successful", "successful_pages"), ("Failed", "failed_pages"),
            ("Success Rate", percent_text("successful_pages", "total_pages")),
            ("Duration", "duration_formatted"), ("Start URL", "start_url"), ("Domain", "domain")]
    lines = ", ".join(f"concat('| {name} | ', {value}, ' |')" for name, value in rows)
    return stats.selectExpr(
        f"concat_ws('\\n', '## Scraping Statistics\\n', '| Metric | Value |', '|--------|-------|', {lines}, "
        "'\\n---\\n') AS value")


def _preamble_lines(stats: DataFrame, separator: str) -> str:
    special = f"[\"\\r\\n{separator}]"
    pairs = ", ".join(f"struct('# {c}' AS key, coalesce(cast({c} as string), 'None') AS value)" for c in stats.columns)
    cell = f"if(p.value rlike '{special}', concat('\"', replace(p.value, '\"', '\"\"'), '\"'), p.value)"
    return f"concat(array('# Statistics'), transform(array({pairs}), p -> concat_ws('{separator}', p.key, {cell})))"


def stats_preamble(stats: DataFrame, separator: str = ",") -> DataFrame:
    """K6: statistics as comment lines ``# key,value``, quoted only where needed."""
    return stats.selectExpr(f"posexplode({_preamble_lines(stats, separator)}) AS (place, value)")


def stats_preamble_text(stats: DataFrame, separator: str = ",") -> DataFrame:
    """K6: the same lines as one text per row of `stats`."""
    return stats.selectExpr(f"array_join({_preamble_lines(stats, separator)}, '\\n') AS value")

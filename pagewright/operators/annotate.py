"""Model annotations: prompts out, responses in, merged into pages and links.

The model itself is outside.  It is either a table of stored responses, or a function
the caller hands to `annotate`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.core import Sql, either, every, non_empty, transform, truncate
from pagewright.functions.text import for_model, json_object, short_summary, whole_object
from pagewright.operators.links import with_link_array

# The wording of the two prompts.
CONTENT_PROMPT_START = "Analyze the following web page content and extract structured information.\n\nURL: "
CONTENT_PROMPT_GOAL = "\nSpecific goal: "
CONTENT_PROMPT_END = """

Your task:
1. Identify and extract the MAIN CONTENT of the page (article, product description, etc.)
2. Filter out navigation menus, advertisements, sidebars, and boilerplate content
3. Extract metadata like title, author, date if available
4. Identify the content type (article, product, listing, etc.)
5. List the main topics covered

Respond in JSON format with the following structure:
{
    "title": "Page title",
    "main_content": "The main text content, cleaned and formatted",
    "summary": "A 2-3 sentence summary",
    "headings": ["List", "of", "headings"],
    "author": "Author name if found",
    "date_published": "Publication date if found",
    "language": "Content language (e.g., 'en')",
    "content_type": "article/product/listing/documentation/other",
    "topics": ["topic1", "topic2"],
    "confidence_score": 0.0-1.0
}

PAGE CONTENT:
"""
LINK_PROMPT_START = (
    "Analyze the following links from a web page and score them by relevance for crawling."
    "\n\nCurrent page context: "
)
LINK_PROMPT_GOAL = "\nCrawl goal: "
LINK_PROMPT_END = """

For each link, determine:
1. Relevance score (0.0-1.0) - how relevant is this link to the crawl goal?
2. Priority (1-5) - 1 is highest priority, 5 is lowest
3. Link type - content, navigation, external, download, social, etc.
4. Should we follow this link? (true/false)
5. Brief reasoning for your decision

Respond in JSON format with an array of analyzed links:
{
    "links": [
        {
            "url": "link url",
            "relevance_score": 0.0-1.0,
            "priority": 1-5,
            "link_type": "content/navigation/external/etc",
            "should_follow": true/false,
            "reasoning": "Brief explanation"
        }
    ]
}

Focus on identifying high-value content links and filtering out:
- Navigation/menu links
- Social media share buttons
- Login/signup links
- Footer links
- Advertisement links

LINKS TO ANALYZE:
"""
# The wording of the summary prompt.
SUMMARY_PROMPT = "Summarize the following content in {} characters or less:\n\n{}\n\nSummary:"

NO_JSON = "No JSON found in response"


def content_prompts(pages: DataFrame, goal: str | None = None, content: str = "html",
                    max_length: int | None = None, separator: str = "") -> DataFrame:
    """M1: the prompt that asks a model to extract a page."""
    wanted = CONTENT_PROMPT_GOAL + goal if goal else ""
    return pages.withColumn("prompt", F.concat(
        F.lit(CONTENT_PROMPT_START), F.col("url"), F.lit(wanted + CONTENT_PROMPT_END + separator),
        F.expr(for_model(content, max_length))))


def link_prompts(parsed: DataFrame, goal: str | None = None, top: int | None = 50, compact: bool = True,
                 context: Sql = "''", page: str = "page_id", max_text: int | None = None) -> DataFrame:
    """One prompt per page with links, from its first links, made inside the row.

    `context` is SQL text over the columns of the page.  The compact line is ``- url: text``, the
    other ``- URL: url | Text: text``; the text is cut to `max_text` characters.
    """
    def line(x):
        text = truncate(f"{x}.anchor.text", max_text)
        return f"concat('- ', {x}.url, ': ', {text})" if compact else f"concat('- URL: ', {x}.url, ' | Text: ', {text})"

    wanted = LINK_PROMPT_GOAL + goal if goal else ""
    separator = "" if compact else "\n\n"
    sent = "_links" if top is None else f"slice(_links, 1, {int(top)})"
    lines = with_link_array(parsed).selectExpr(page, f"{context} AS _context", f"{transform(sent, line)} AS _lines")
    return lines.filter("size(_lines) > 0").select(page, F.concat(
        F.lit(LINK_PROMPT_START), F.col("_context"), F.lit(wanted + LINK_PROMPT_END + separator),
        F.array_join("_lines", "\n")).alias("prompt"))


def page_context(title: Sql, summary: Sql) -> Sql:
    """The context line of a link prompt."""
    return f"concat('Title: ', {title}, '\\nSummary: ', {summary})"


def summary_prompts(pages: DataFrame, content: str, max_length: int = 500, max_content: int | None = None) -> DataFrame:
    """M6: the prompt that asks a model for a summary of up to `max_length` characters."""
    before, after = SUMMARY_PROMPT.format(max_length, "\0").split("\0")
    return pages.withColumn("prompt", F.concat(F.lit(before), F.expr(for_model(content, max_content)), F.lit(after)))


def parse_content_responses(responses: DataFrame, body: str = "body", strict: bool = False) -> DataFrame:
    """A model's answer about a page as columns.

    An answer without usable JSON gives empty fields and confidence 0, with the reason in
    ``summary`` (or, when `strict`, in ``extraction_notes``).  `strict` accepts only answers
    that are JSON as a whole.
    """
    def text(name, default):
        # A key that is present with null stays null; only a missing key takes the default.
        value = f"try_variant_get(_json, '$.{name}', 'string')"
        return f"if(array_contains(_keys, '{name}'), {value}, {default})"

    def texts(name):
        return f"coalesce(try_variant_get(_json, '$.{name}', 'array<string>'), cast(array() as array<string>))"

    raw = whole_object(body) if strict else json_object(body, fenced=True)
    found = responses.selectExpr("*", f"{raw} AS _raw").selectExpr(
        "*", "try_parse_json(_raw) AS _json", "json_object_keys(_raw) AS _keys")
    score = ("if(array_contains(_keys, 'confidence_score'), "
             "try_cast(try_variant_get(_json, '$.confidence_score', 'string') as double), 0D)")
    scored = found.selectExpr("*", f"{score} AS _score").selectExpr(
        # A score that is no number makes the whole answer unusable.
        "*", "(_raw is not null and _score is not null) AS _usable")
    fields = {
        "title": text("title", "''"), "main_content": text("main_content", "''"),
        "summary": text("summary", "''"), "headings": texts("headings"), "paragraphs": texts("paragraphs"),
        "author": text("author", "null"), "date_published": text("date_published", "null"),
        "date_modified": text("date_modified", "null"), "language": text("language", "null"),
        "content_type": text("content_type", "'unknown'"), "topics": texts("topics"),
        "confidence_score": "_score", "extraction_notes": text("extraction_notes", "''"),
    }
    none = "cast(array() as array<string>)"
    empty = {
        "title": "''", "main_content": "''", "summary": f"'Error: {NO_JSON}'", "headings": none,
        "paragraphs": none, "author": "null", "date_published": "null", "date_modified": "null",
        "language": "null", "content_type": "'article'", "topics": none, "confidence_score": "0D",
        "extraction_notes": "''",
    }
    if strict:
        empty |= {"summary": "''", "extraction_notes": f"'Extraction failed: {NO_JSON}'"}
    kept = [c for c in responses.columns if c != body]
    return scored.selectExpr(*kept, *[f"if(_usable, {fields[c]}, {empty[c]}) AS {c}" for c in fields])


_SCORE_ITEM = (
    "array<struct<url:string,text:string,relevance_score:string,priority:string,link_type:string,"
    "expected_content_type:string,reasoning:string,should_follow:string>>"
)


def parse_link_scores(responses: DataFrame, body: str = "body", strict: bool = False) -> DataFrame:
    """A model's answer about links as one row per link, with its place in the answer.

    With `strict` only answers that are JSON as a whole count, and a link without
    ``should_follow`` is not followed.
    """
    raw = whole_object(body) if strict else json_object(body, fenced=False)
    kept = [c for c in responses.columns if c != body]
    numeric = every("_links", lambda x: (
        f"(({x}.relevance_score is null or try_cast({x}.relevance_score as double) is not null) and "
        f"({x}.priority is null or try_cast({x}.priority as int) is not null))"))
    # One score that is no number makes the whole answer unusable.
    items = responses.selectExpr(*kept, f"from_json({raw}, 'links {_SCORE_ITEM}').links AS _links").selectExpr(
        *kept, f"if({numeric}, _links, null) AS _links")
    follow = f"coalesce(lower(_l.should_follow) not in ('false', '0', ''), {'false' if strict else 'true'})"
    return items.selectExpr(*kept, "posexplode_outer(_links) AS (place, _l)").filter("place is not null").selectExpr(
        *kept, "place", "coalesce(_l.url, '') AS url", "coalesce(_l.text, '') AS text",
        "coalesce(try_cast(_l.relevance_score as double), 0D) AS relevance_score",
        "coalesce(try_cast(_l.priority as int), 5) AS priority",
        "coalesce(_l.link_type, 'unknown') AS link_type",
        "coalesce(_l.expected_content_type, 'unknown') AS expected_content_type",
        "coalesce(_l.reasoning, '') AS reasoning", f"{follow} AS should_follow")


def fallback_scores(links: DataFrame, page: str = "page_id") -> DataFrame:
    """M5: the scores used when a model fails: 0.5 and follow.  Links sent are `extract_links(..., top=n)`."""
    return links.selectExpr(
        page, "page_url", "url", "text", "0.5D AS relevance_score", "0 AS priority",
        "'content' AS link_type", "'unknown' AS expected_content_type", "'' AS reasoning",
        "true AS should_follow")


def merge_scores(links: DataFrame, scores: DataFrame, on: list[str] = ("page_url", "url")) -> DataFrame:
    """Scored links take the type and the follow flag of their score, others keep theirs.

    Of several scores for a link the last in the answer counts; without a ``place``, or with
    equal ones, the largest by relevance, type and flag.
    """
    fields = ["relevance_score", "link_type", "should_follow"]
    place = ["place"] if "place" in scores.columns else []
    best = scores.groupBy(*on).agg(F.max(F.struct(*place, *fields)).alias("_score"))
    return links.join(best, list(on), "left").select(
        *[c for c in links.columns if c not in ("link_type", "follow")],
        F.coalesce("_score.link_type", "link_type").alias("link_type"),
        F.coalesce("_score.should_follow", "follow").alias("follow"),
        F.coalesce("_score.relevance_score", F.lit(0.5)).alias("relevance_score"))


def merge_annotations(records: DataFrame, annotations: DataFrame, on: str = "page_id") -> DataFrame:
    """Non-empty model fields replace those of the record.

    Of several annotations of a page, each field takes the largest non-empty value.
    """
    replaced = ["main_content", "title", "author", "date_published"]
    added = ["summary", "content_type"]
    side = annotations.groupBy(on).agg(*[F.max(F.expr(non_empty(c))).alias(f"_{c}") for c in replaced + added])
    joined = records.join(side, on, "left")
    return joined.selectExpr(
        *[c for c in records.columns if c not in replaced],
        *[f"{either(non_empty(f'_{c}'), c)} AS {c}" for c in replaced],
        *[f"{either(non_empty(f'_{c}'), default)} AS {c}" for c, default in zip(added, ["''", "'unknown'"])])


def with_summaries(pages: DataFrame, content: str, response: str | None = None,
                   max_length: int = 500, on_failure: str = "start") -> DataFrame:
    """M6: the model's summary cut to length; without one, the start of the content or ''."""
    fallback = short_summary(content, max_length) if on_failure == "start" else "''"
    given = truncate(response, max_length) if response else "cast(null as string)"
    return pages.withColumn("summary", F.expr(either(given, fallback)))


def annotate(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """M7: run a caller's model function over Arrow batches of rows, wherever the rows are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return rows.mapInPandas(run, schema)

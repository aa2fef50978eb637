"""Page records: title, metadata, main content, structure and links of each page.

Input is the output of `parse_pages`.  Every operator is a projection: one row in,
one row out, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import nodes as N
from pagewright.functions.core import (
    Sql, collapse_spaces, count_contained, either, exists, keep, let, non_empty, strip, struct,
    transform, truncate, words,
)
from pagewright.functions.text import unescape_html
from pagewright.functions.urls import has_bad_brackets, is_page_href, netloc, resolve_parts, split_url

# Elements that may hold the main content, in order of preference.
CONTENT_TAGS = ["article", "main", "div", "section"]
# Substrings of class or id that mark content.
CONTENT_INDICATORS = [
    "content", "article", "post", "entry", "text",
    "body", "main", "story", "news",
]
# Names under which pages state their dates.
PUBLISHED_PROPS = ["article:published_time", "datePublished", "pubdate"]
MODIFIED_PROPS = ["article:modified_time", "dateModified"]

# Texts are whole unless a length is given; this is the length that reports usually take.
MAX_CONTENT_LENGTH = 100_000
BAD_URL = "Invalid IPv6 URL"

RECORD_FIELDS = [
    "title", "main_content", "text", "meta_description", "meta_keywords", "language",
    "headings", "paragraphs", "lists", "images", "internal_links", "external_links",
    "author", "date_published", "date_modified",
]


# --- metadata: read from the whole tree ------------------------------------------------

def meta_content(elements: Sql, attribute: str, value: str) -> Sql:
    """Content of the first ``<meta attribute=value>``, NULL when missing or empty."""
    found = N.first_where(elements, lambda e: f"{e}.tag = 'meta' and {N.attr(e, attribute)} = '{value}'")
    return N.filled_attr(found, "content")


def raw_title(heads: Sql, elements: Sql, texts: Sql) -> Sql:
    """The single string of ``<title>``, NULL when there is none."""
    return let(N.first_tag(heads, "title"), lambda t: non_empty(N.single_string(elements, texts, t)))


def title(heads: Sql, elements: Sql, texts: Sql, strings: Sql) -> Sql:
    """``<title>``, else og:title, else the first h1, else ''."""
    return either(
        strip(raw_title(heads, elements, texts)), strip(meta_content(heads, "property", "og:title")),
        let(N.first_tag(heads, "h1"), lambda h: N.element_text(strings, h)), "''")


def meta_description(heads: Sql) -> Sql:
    """P5"""
    return either(strip(meta_content(heads, "name", "description")),
                  strip(meta_content(heads, "property", "og:description")), "''")


def meta_keywords(heads: Sql) -> Sql:
    """P6"""
    parts = transform(f"split({meta_content(heads, 'name', 'keywords')}, ',')", strip)
    return either(keep(parts, lambda k: f"{k} <> ''"), N.NO_STRINGS)


def language(heads: Sql) -> Sql:
    """P7"""
    return either(N.filled_attr(N.first_tag(heads, "html"), "lang"),
                  meta_content(heads, "http-equiv", "content-language"), "''")


def author(heads: Sql, texts: Sql, strings: Sql) -> Sql:
    """Meta author, else the itemprop author, else the rel=author link, else NULL."""
    marked = N.first_where(heads, lambda e: f"{N.attr(e, 'itemprop')} = 'author'")
    linked = N.first_where(heads, lambda e: (
        f"{e}.tag = 'a' and array_contains(split({N.tokens(N.attr(e, 'rel'))}, ' '), 'author')"))
    return either(
        strip(meta_content(heads, "name", "author")),
        let(marked, lambda e: N.boxed_text(texts, strings, e)),
        let(linked, lambda e: N.element_text(strings, e)))


def _dated(heads: Sql, texts: Sql, strings: Sql, props: list[str]) -> list[Sql]:
    def by(prop):
        meta = N.first_where(heads, lambda e: f"{e}.tag = 'meta' and {N.attr(e, 'property')} = '{prop}'")
        marked = N.first_where(heads, lambda e: f"{N.attr(e, 'itemprop')} = '{prop}'")
        return let(either(meta, marked), lambda e: (
            f"if({e} is not null, {either(N.filled_attr(e, 'content'), N.boxed_text(texts, strings, e))}, null)"))

    return [by(prop) for prop in props]


def date_published(heads: Sql, texts: Sql, strings: Sql) -> Sql:
    """P9"""
    timed = N.first_where(heads, lambda e: f"{e}.tag = 'time' and {N.attr(e, 'datetime')} is not null")
    return either(*_dated(heads, texts, strings, PUBLISHED_PROPS), N.attr(timed, "datetime"))


def date_modified(heads: Sql, texts: Sql, strings: Sql) -> Sql:
    """P10"""
    return either(*_dated(heads, texts, strings, MODIFIED_PROPS))


def head_elements(elements: Sql) -> Sql:
    """The few elements that can hold metadata, picked once instead of once per field."""
    return keep(elements, lambda e: (
        f"{e}.tag in ('meta', 'title', 'html', 'h1', 'time') "
        f"or ({e}.tag = 'a' and {N.attr(e, 'rel')} is not null) or {N.attr(e, 'itemprop')} is not null"))


# --- content: read from the tree after noise removal -----------------------------------

def content_score(element: Sql, gone: Sql | None = None) -> Sql:
    """How likely an element is to be the main content.

    The parse job knows what is inside every element; of a tree without noise, `gone`
    (`nodes.noise_totals`) says what to take off.  So the cost does not depend on the element's size.
    """
    def inside(what):
        if gone is None:
            return f"{element}.{what}"
        return f"({element}.{what} - (get({gone}, {element}.last - 1).{what} - get({gone}, {element}.pos - 1).{what}))"

    named = let(N.class_and_id(element), lambda c: (
        f"{count_contained(c, CONTENT_INDICATORS)} * 10 - {count_contained(c, N.NOISE_INDICATORS)} * 20"))
    return f"(cast({named} + {inside('paragraphs')} * 2 as double) + least({inside('chars')} / 100D, 50D))"


def best_candidate(elements: Sql, noise: Sql = N.NO_RANGES) -> Sql:
    """The best-scored content element; the first wins a tie, a score must be positive."""
    def scored(gone):
        return transform(N.with_tag(elements, *CONTENT_TAGS), lambda e: struct(
            score=content_score(e, gone),
            tag_rank=f"-array_position(array({words(CONTENT_TAGS)}), {e}.tag)",
            rank=f"-{e}.pos"))

    best = f"array_max({keep(let(N.noise_totals(elements, noise), scored), lambda s: s + '.score > 0')})"
    return let(best, lambda b: f"if({b} is not null, get({elements}, -{b}.rank - 1), null)")


def main_content(elements: Sql, strings: Sql, max_length: int | None = None, noise: Sql = "_noise") -> Sql:
    """Article, else main, else the best-scored element, else body, else ''."""
    chosen = either(N.first_tag(elements, "article"), N.first_tag(elements, "main"),
                    best_candidate(elements, noise), N.first_tag(elements, "body"))
    return let(chosen, lambda e: (
        f"if({e} is not null, {truncate(N.element_text(strings, e, ' '), max_length)}, '')"))


def page_text(strings: Sql, max_length: int | None = None) -> Sql:
    """All text with single blanks."""
    return truncate(collapse_spaces(N.join_strings(strings, " ")), max_length)


def headings(elements: Sql, strings: Sql) -> Sql:
    """h1 to h6, by level, then in document order."""
    levels = [f"h{n}" for n in range(1, 7)]
    found = let(strings, lambda own: transform(N.with_tag(elements, *levels), lambda e: struct(
        level=f"{e}.tag", text=N.element_text(own, e))))
    return let(keep(found, lambda h: f"{h}.text <> ''"), lambda all_levels: "concat(" + ", ".join(
        keep(all_levels, lambda h: f"{h}.level = '{level}'") for level in levels) + ")")


def paragraphs(elements: Sql, strings: Sql) -> Sql:
    """Paragraph texts longer than 20 characters."""
    found = let(strings, lambda own: transform(N.with_tag(elements, "p"), lambda e: N.element_text(own, e)))
    return keep(found, lambda t: f"length({t}) > 20")


def lists(elements: Sql, strings: Sql) -> Sql:
    """The items directly below each list; lists without text are skipped."""
    def items(whole, own, e):
        children = keep(N.descendants(whole, e), lambda c: f"{c}.tag = 'li' and {c}.parent = {e}.pos")
        return keep(transform(children, lambda c: N.element_text(own, c)), lambda t: f"{t} <> ''")

    found = let(elements, lambda whole: let(strings, lambda own: transform(
        N.with_tag(whole, "ul", "ol"), lambda e: items(whole, own, e))))
    return keep(found, lambda items_of: f"size({items_of}) > 0")


def images(elements: Sql) -> Sql:
    """P18"""
    found = transform(N.with_tag(elements, "img"), lambda e: struct(
        src=either(N.filled_attr(e, "src"), N.attr(e, "data-src"), "''"),
        alt=either(N.attr(e, "alt"), "''"), title=either(N.attr(e, "title"), "''")))
    return keep(found, lambda i: f"{i}.src <> ''")


def page_hrefs(elements: Sql) -> Sql:
    """L1 inside a page: stripped hrefs that can lead to a page."""
    anchors = keep(elements, lambda e: f"{e}.tag = 'a' and {N.attr(e, 'href')} is not null")
    return keep(transform(anchors, lambda a: strip(N.attr(a, "href"))), is_page_href)


def page_links(elements: Sql, url: Sql) -> Sql:
    """Distinct absolute links in first-seen order, with their authority."""
    def resolve_all(base):
        return let(split_url(base), lambda b: transform(
            page_hrefs(elements), lambda h: f"if({base} = '', {h}, {resolve_parts(b, h)})"))

    resolved = let(either(url, "''"), resolve_all)
    return transform(f"array_distinct({resolved})", lambda u: struct(url=u, netloc=netloc(u)))


# --- composites ------------------------------------------------------------------------

def _passed_through(parsed: DataFrame) -> list[str]:
    return [c for c in parsed.columns if c not in ("elements", "texts", "parse_error")]


def with_clean_tree(parsed: DataFrame, remove_noise: bool = True) -> DataFrame:
    """Add the working columns ``_elements``, ``_texts``, ``_strings`` and ``_noise``."""
    if not remove_noise:
        return parsed.selectExpr("*", "elements AS _elements", "texts AS _texts",
                                 f"{N.page_strings('texts')} AS _strings", f"{N.NO_RANGES} AS _noise")
    return (
        parsed.selectExpr("*", f"{N.noise_ranges('elements')} AS _noise")
        .selectExpr("*", f"{N.without_noise('elements', '_noise')} AS _elements",
                    f"{N.texts_without_noise('texts', '_noise')} AS _texts")
        .selectExpr("*", f"{N.page_strings('_texts')} AS _strings")
    )


def with_heads(parsed: DataFrame) -> DataFrame:
    """Add the working columns ``_heads`` and ``_all_strings`` that metadata is read from."""
    return parsed.selectExpr("*", f"{head_elements('elements')} AS _heads",
                             f"{N.page_strings('texts')} AS _all_strings")


def extract_pages(parsed: DataFrame, remove_noise: bool = True, extract_images: bool = True,
                  max_content_length: int | None = None, url_col: str = "url") -> DataFrame:
    """The structured record of every page.

    Metadata comes from the whole tree, structure from the tree without noise.  A page
    that fails keeps its row with ``extraction_success = false`` and the reason.
    """
    kept = _passed_through(parsed)
    head = {
        "title": title("_heads", "elements", "texts", "_all_strings"),
        "meta_description": meta_description("_heads"),
        "meta_keywords": meta_keywords("_heads"),
        "language": language("_heads"),
        "author": author("_heads", "texts", "_all_strings"),
        "date_published": date_published("_heads", "texts", "_all_strings"),
        "date_modified": date_modified("_heads", "texts", "_all_strings"),
    }
    no_images = "cast(array() as array<struct<src:string,alt:string,title:string>>)"
    body = {
        "main_content": main_content("_elements", "_strings", max_content_length),
        "text": page_text("_strings", max_content_length),
        "headings": headings("_elements", "_strings"),
        "paragraphs": paragraphs("_elements", "_strings"),
        "lists": lists("_elements", "_strings"),
        "images": images("_elements") if extract_images else no_images,
        "_links": page_links("_elements", url_col),
    }
    whole = with_heads(parsed).selectExpr(
        *kept, "elements", "texts", "parse_error", *[f"{e} AS {c}" for c, e in head.items()])
    full = with_clean_tree(whole, remove_noise).selectExpr(
        *kept, "parse_error", *head, *[f"{e} AS {c}" for c, e in body.items()])
    return _finish_record(full, kept, url_col)


def _finish_record(full: DataFrame, kept: list[str], url_col: str) -> DataFrame:
    host = netloc(either(url_col, "''"))
    bad_url = f"({exists('_links', lambda x: has_bad_brackets(x + '.netloc'))} or {has_bad_brackets('_host')})"
    internal = "({0}.netloc = _host or ({0}.netloc = '' and _host <> ''))".format
    with_error = full.selectExpr("*", f"{host} AS _host").selectExpr(
        "*", f"coalesce(parse_error, if({bad_url}, '{BAD_URL}', null)) AS error")

    def urls(condition):
        return transform(keep("_links", condition), lambda x: f"{x}.url")

    fields = {name: name for name in RECORD_FIELDS} | {
        "internal_links": urls(internal), "external_links": urls(lambda x: f"not {internal(x)}")}

    def value(name):
        if name in ("author", "date_published", "date_modified"):
            empty = "null"
        elif name in ("internal_links", "external_links"):
            empty = N.NO_STRINGS
        else:
            kind = full.schema[name].dataType
            empty = f"cast(array() as {kind.simpleString()})" if isinstance(kind, T.ArrayType) else "''"
        return f"if(error is null, {fields[name]}, {empty}) AS {name}"

    return with_error.selectExpr(
        *kept, *[value(name) for name in RECORD_FIELDS], "error is null AS extraction_success", "error")


def page_record(records: DataFrame) -> DataFrame:
    """The public record, with links and images as counts."""
    return records.select(
        *[c for c in ("page_id",) if c in records.columns],
        "url", "title", "main_content", "text", "meta_description", "meta_keywords", "language",
        "headings", "author", "date_published", "date_modified",
        F.size("internal_links").alias("internal_links_count"),
        F.size("external_links").alias("external_links_count"),
        F.size("images").alias("images_count"),
        "extraction_success", "error",
    )


def basic_record(parsed: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Raw title, whole text and meta description; NULL where there is none."""
    described = N.first_where(
        "elements", lambda e: f"{e}.tag = 'meta' and {N.attr(e, 'name')} = 'description'")
    all_text = truncate(N.join_strings(N.page_strings("texts"), " "), max_chars)
    return parsed.selectExpr(
        *_passed_through(parsed),
        f"{raw_title('elements', 'elements', 'texts')} AS title",
        f"{non_empty(all_text)} AS text",
        f"{N.attr(described, 'content')} AS meta_description",
        "parse_error AS error",
    )


def strip_tags(html: Sql, max_length: int | None = None) -> Column:
    """Text of broken html: cut tags, decode entities, single blanks."""
    cut = f"regexp_replace({html}, '<[^>]+>', ' ')"
    return F.expr(truncate(strip(collapse_spaces(let(cut, unescape_html))), max_length))


def text_only(parsed: DataFrame, remove_noise: bool = True,
              max_length: int | None = None) -> DataFrame:
    """Only the text; pages that failed to parse fall back to `strip_tags`.

    The fallback needs the html column (``parse_pages(..., keep_html=True)``).
    """
    kept = [c for c in _passed_through(parsed) if c != "html"]
    broken = ["if(parse_error is not null, html, null) AS _broken"] if "html" in parsed.columns else []
    found = with_clean_tree(parsed, remove_noise).selectExpr(
        *kept, f"if(parse_error is null, {page_text('_strings', max_length)}, null) AS text", *broken)
    if not broken:
        return found
    return found.select(*kept, F.coalesce("text", strip_tags("_broken", max_length), F.lit("")).alias("text"))


def min_content(records: DataFrame, length: int = 100) -> DataFrame:
    """Keep pages whose main content has at least `length` characters.

    The generator keeps the filter above the extraction.  Pushed below it, the filter would
    carry a copy of the expressions for the whole main content and run them a second time.
    """
    whole = ", ".join(f"'{c}', {c}" for c in records.columns)
    return records.selectExpr(f"inline_outer(array(named_struct({whole})))").filter(
        F.length("main_content") >= length)


def to_results(records: DataFrame, **columns: Sql) -> DataFrame:
    """P25: page records as export rows.  `columns` fills fields that are empty by default."""
    id_columns = [c for c in ("page_id",) if c in records.columns]
    defaults = {
        "url": "url", "title": "coalesce(title, '')",
        "content": either(non_empty("main_content"), non_empty("text"), "''"),
        "meta_description": "meta_description",
        "headings": "cast(map() AS map<string,array<string>>)",
        "links": "cast(array() AS array<map<string,string>>)",
        "images": "cast(array() AS array<map<string,string>>)",
        "summary": "''", "topics": "cast(array() AS array<string>)", "content_type": "'unknown'",
        "scraped_at": "''", "load_time_ms": "0D", "status_code": "200",
    }
    return records.selectExpr(*id_columns, *[f"{e} AS {c}" for c, e in (defaults | columns).items()])

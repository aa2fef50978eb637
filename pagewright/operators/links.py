"""Link tables: one row per link of a page, normalised, deduplicated and classified.

Links are resolved and deduplicated inside the row of their page, so the whole link
table is a map-only job; nothing is shuffled before a caller aggregates or joins.

Arrays become rows with the outer generators: for the others Spark infers a filter on
the array's size, pushes it below the projections, and so builds every array twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import nodes as N
from pagewright.functions.core import (
    SPACE_CLASS, Sql, collapse_spaces, either, exists, keep, let, regex, strip, struct, transform, truncate,
)
from pagewright.operators.content import page_hrefs
from pagewright.functions.urls import (
    browser_url, hostname, is_internal, is_page_href, is_resource, is_unreadable, link_type, netloc,
    normalize_url, resolve_parts, resolve_url, split_url, url_path,
)

# Substrings of an ancestor's class or id that mark navigation.
NAVIGATION_AREAS = ["nav", "menu", "header", "footer"]
# Link texts that mark navigation.
NAVIGATION_TEXTS = ["menu", "home", "back", "next", "prev(ious)?"]

LINK_COLUMNS = [
    "url", "text", "title", "is_internal", "is_navigation", "is_resource", "link_type",
    "follow", "rel", "target",
]
PUBLIC_COLUMNS = LINK_COLUMNS[:7]


def _anchors(elements: Sql, texts: Sql, max_text: int | None = None) -> Sql:
    """The anchors of a page with everything read from the tree."""

    def describe(a):
        inside = transform(N.inner(texts, a), lambda t: f"if({t}.box = '', {strip(t + '.raw')}, '')")
        own = N.join_strings(inside)
        named = either(f"nullif({own}, '')", N.filled_attr(a, "title"), N.attr(a, "aria-label"), "''")
        in_navigation = N.near_ancestor(elements, a, 3, lambda p: N.marked_with(p, NAVIGATION_AREAS))
        return struct(
            pos=f"{a}.pos", href=strip(N.attr(a, "href")), text=truncate(named, max_text),
            title=either(N.attr(a, "title"), "''"),
            rel=either(N.tokens(N.attr(a, "rel")), "''"), target=either(N.attr(a, "target"), "''"),
            in_navigation=in_navigation)

    anchors = keep(elements, lambda e: f"{e}.tag = 'a' and {N.attr(e, 'href')} is not null")
    return keep(transform(anchors, describe), lambda a: is_page_href(a + ".href"))


def _first_per_url(links: Sql) -> Sql:
    """The first link per URL, in document order.

    Sorting by (url, pos) puts duplicates side by side, which stays cheap for pages
    with very many links.
    """
    return let(f"sort_array({links})", lambda s: "sort_array(" + transform(
        keep(s, lambda x, i: f"({i} = 0 or get({s}, {i} - 1).url <> {x}.url)", 2),
        lambda x: struct(pos=f"{x}.pos", url=f"{x}.url", anchor=f"{x}.anchor")) + ")")


def with_link_array(parsed: DataFrame, url_col: str = "url", strip_tracking: bool = True,
                    include_fragments: bool = False, max_text: int | None = None) -> DataFrame:
    """L1-L7 inside the row: adds ``_links``, array<struct<pos, url, anchor>> in document order."""
    def absolute(base):
        return transform("_anchors", lambda a: struct(
            url=f"if({url_col} = '', {a}.href, {resolve_parts(base, a + '.href')})", anchor=a))

    resolved = parsed.selectExpr("*", f"{_anchors('elements', 'texts', max_text)} AS _anchors").selectExpr(
        "*", f"{let(split_url(url_col), absolute)} AS _absolute")
    # A single unreadable address makes the page's link extraction fail as a whole.
    bad = exists("_absolute", lambda x: is_unreadable(x + ".url"))
    normal = keep(transform(f"if({bad}, array(), _absolute)", lambda x: struct(
        url=normalize_url(x + ".url", strip_tracking, include_fragments),
        pos=f"{x}.anchor.pos", anchor=f"{x}.anchor")), lambda x: f"{x}.url is not null")
    return (
        resolved.selectExpr("*", f"{normal} AS _normal")
        .selectExpr("*", f"{_first_per_url('_normal')} AS _links")
        .drop("_anchors", "_absolute", "_normal")
    )


def with_targets(parsed: DataFrame, url_col: str = "url", strip_tracking: bool = True, include_fragments: bool = False) -> DataFrame:
    """L1-L6 for those who only follow links: adds ``_targets``, the distinct normalised addresses in document order.

    The same addresses as those of `with_link_array`, without texts and attributes.
    """
    def absolute(base):
        return transform("_hrefs", lambda h: f"if({url_col} = '', {h}, {resolve_parts(base, h)})")

    resolved = parsed.selectExpr("*", f"{page_hrefs('elements')} AS _hrefs").selectExpr(
        "*", f"{let(split_url(url_col), absolute)} AS _absolute")
    bad = exists("_absolute", is_unreadable)
    normal = keep(transform(f"if({bad}, array(), _absolute)", lambda x: normalize_url(x, strip_tracking, include_fragments)),
                  lambda x: f"{x} is not null")
    return resolved.selectExpr("*", f"array_distinct({normal}) AS _targets").drop("_hrefs", "_absolute")


def extract_links(parsed: DataFrame, base_url_col: str | None = None, url_col: str = "url",
                  strip_tracking: bool = True, include_fragments: bool = False, max_text: int | None = None,
                  top: int | None = None) -> DataFrame:
    """The link table of all pages, or of the first `top` links of each page.

    Columns: ``page_id`` (when present), ``page_url``, ``pos`` (document order within the
    page) and the ten link fields.  ``base_url_col`` names the column whose host decides
    what is internal; the default is the page's own URL.
    """
    ids = [c for c in ("page_id", "seed") if c in parsed.columns]
    rows = (
        with_link_array(parsed, url_col, strip_tracking, include_fragments, max_text)
        .selectExpr(*ids, f"{url_col} AS page_url", f"lower({netloc(base_url_col or url_col)}) AS _base_host",
                    "inline_outer(_links)" if top is None else f"inline_outer(slice(_links, 1, {int(top)}))")
        .filter("pos is not null")
        .selectExpr("*", f"lower({netloc('url')}) AS _host", f"lower({url_path('url')}) AS _path")
    )
    only_navigation = regex(f"(?U)^{SPACE_CLASS}*({'|'.join(NAVIGATION_TEXTS)}){SPACE_CLASS}*$")
    return rows.selectExpr(
        *ids, "page_url", "pos", "url", "anchor.text AS text", "anchor.title AS title",
        f"{is_internal('_host', '_base_host')} AS is_internal",
        f"(contains(lower(anchor.rel), 'nofollow') or lower(anchor.text) rlike {only_navigation} "
        "or anchor.in_navigation) AS is_navigation",
        f"{is_resource('_path')} AS is_resource",
        f"{link_type('_host', '_path', 'anchor.text')} AS link_type",
        "true AS follow", "substring_index(anchor.rel, ' ', 1) AS rel", "anchor.target AS target",
    )


def internal(links: DataFrame) -> DataFrame:
    """L14"""
    return links.filter("is_internal")


def external(links: DataFrame) -> DataFrame:
    """L15"""
    return links.filter("not is_internal")


def content_links(links: DataFrame) -> DataFrame:
    """Internal links that likely lead to content."""
    return links.filter("is_internal and not is_navigation and not is_resource and link_type = 'content'")


def unique_urls(links: DataFrame) -> DataFrame:
    """Each URL once, with the place it was first seen."""
    order = [c for c in ("page_id", "pos") if c in links.columns]
    return links.groupBy("url").agg(F.min(F.struct(*order)).alias("first_seen")).select(
        "url", "first_seen.*")


def public_columns(links: DataFrame) -> DataFrame:
    """The seven public link fields."""
    ids = [c for c in ("page_id", "page_url", "pos") if c in links.columns]
    return links.select(*ids, *PUBLIC_COLUMNS)


def with_same_domain_targets(parsed: DataFrame, start_url: Sql = "url", url_col: str = "url") -> DataFrame:
    """L3 inside the row: adds ``targets``, the distinct links on the start URL's authority.

    `start_url` is SQL text: a column, or a quoted literal.  No href is skipped and
    nothing is normalised."""
    anchors = keep("elements", lambda e: f"{e}.tag = 'a' and {N.attr(e, 'href')} is not null")
    resolved = let(split_url(url_col), lambda b: transform(
        "_hrefs", lambda h: f"case when {h} = '' then {url_col} when {url_col} = '' then {h} "
                            f"else {resolve_parts(b, h)} end"))
    return (
        parsed.selectExpr("*", f"{transform(anchors, lambda a: N.attr(a, 'href'))} AS _hrefs",
                          f"{netloc(start_url)} AS _domain")
        .selectExpr("*", f"array_distinct({resolved}) AS _urls")
        .selectExpr("*", f"{keep('_urls', lambda u: netloc(u) + ' = _domain')} AS targets")
        .drop("_hrefs", "_domain", "_urls")
    )


def same_domain_links(parsed: DataFrame, start_url: Sql = "url", url_col: str = "url") -> DataFrame:
    """L3: one row per distinct link on the start URL's authority."""
    ids = [c for c in ("page_id", "seed") if c in parsed.columns]
    return with_same_domain_targets(parsed, start_url, url_col).selectExpr(
        *ids, f"{url_col} AS page_url", "explode_outer(targets) AS url").filter("url is not null")


def link_counts(parsed: DataFrame, url_col: str = "url") -> DataFrame:
    """A5: internal and external links of every page that has links, counted inside its row."""
    ids = [c for c in ("page_id", "seed") if c in parsed.columns]

    def host(x):
        return f"lower({netloc(x + '.url')})"

    hosts = with_link_array(parsed, url_col).selectExpr(
        *ids, f"lower({netloc(url_col)}) AS _base", f"{transform('_links', host)} AS _hosts")
    return hosts.selectExpr(*ids, f"size({keep('_hosts', lambda h: is_internal(h, '_base'))}) AS internal_links_count", "_hosts").filter(
        "size(_hosts) > 0").selectExpr(
            *ids, "CAST(internal_links_count AS long) AS internal_links_count",
            "CAST(size(_hosts) - internal_links_count AS long) AS external_links_count")


def hostname_links(parsed: DataFrame, same_domain: bool = True, url_col: str = "url",
                   max_text: int | None = None) -> DataFrame:
    """Links as a browser reports them: internal by host name, distinct by address."""
    ids = [c for c in ("page_id",) if c in parsed.columns]

    def visible_text(a):
        raw = transform(keep(N.inner("texts", a), lambda t: f"{t}.box = ''"), lambda t: f"{t}.raw")
        return truncate(strip(collapse_spaces(f"array_join({raw}, '')")), max_text)

    def absolute(base):
        return transform("_anchors", lambda a: struct(
            url=browser_url(f"if({a}.href = '', {url_col}, {resolve_parts(base, a + '.href')})"),
            pos=f"{a}.pos", anchor=a))

    anchors = transform(
        keep("elements", lambda e: f"{e}.tag = 'a' and {N.attr(e, 'href')} is not null"),
        lambda a: struct(href=strip(N.attr(a, "href")), pos=f"{a}.pos", text=visible_text(a)))
    rows = (
        parsed.selectExpr(*ids, f"{url_col} AS page_url", url_col, f"{anchors} AS _anchors")
        .selectExpr(*ids, "page_url", f"{let(split_url(url_col), absolute)} AS _links")
        .selectExpr(*ids, "page_url", f"{_first_per_url('_links')} AS _links")
        .selectExpr(*ids, "page_url", "inline_outer(_links)")
        .filter("pos is not null")
        .selectExpr(*ids, "page_url", "pos", "url AS href", "anchor.text AS text",
                    f"({hostname('url')} = {hostname('page_url')}) AS is_internal")
    )
    return rows.filter("is_internal") if same_domain else rows


def followable(links: DataFrame, visited: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Links to follow that were not visited yet."""
    return links.filter("follow").join(visited, on or ["url"], "left_anti")


def absolute_links(parsed: DataFrame, url_col: str = "url") -> DataFrame:
    """L1, L2: every page link in document order, resolved, not yet normalised."""
    ids = [c for c in ("page_id",) if c in parsed.columns]
    hrefs = keep(transform(
        keep("elements", lambda e: f"{e}.tag = 'a' and {N.attr(e, 'href')} is not null"),
        lambda a: struct(pos=f"{a}.pos", href=strip(N.attr(a, "href")))), lambda a: is_page_href(a + ".href"))
    return (
        parsed.selectExpr(*ids, f"{url_col} AS page_url", f"inline_outer({hrefs})")
        .filter("pos is not null")
        .selectExpr(*ids, "page_url", "pos", "href", f"{resolve_url('page_url', 'href')} AS abs_url")
    )

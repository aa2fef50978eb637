"""Queries over links: normalisation, classification, link tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators import crawl as G
from pagewright.operators import links as L
from pagewright.plans import oracle as O
from pagewright.plans.page_queries import pages, parsed, table
from pagewright.session import scratch_folder
from pagewright.sources.parse import parse_pages


def links(spark, sf_dir):
    return L.extract_links(parsed(spark, sf_dir))


def shared_links(spark, sf_dir):
    """The link table for queries that read it more than once, written to the shared scratch folder."""
    found, folder = links(spark, sf_dir), scratch_folder(spark, "links")
    found.write.parquet(folder)
    return spark.read.schema(found.schema).parquet(folder)


def rewritten(spark, sf_dir, old, new):
    """The given pages with a piece of markup replaced everywhere."""
    return pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit(old), F.lit(new)))


def absolute_links(spark, sf_dir):
    return L.absolute_links(parsed(spark, sf_dir)).select("page_id", "href", "abs_url")


def relative_links(spark, sf_dir):
    """Resolution of relative, parent and query references on the given addresses."""
    hrefs = ["x/y", "../x", "./x", "?q=1", "//other.org/p", "/a/../b", "#f"]
    rows = pages(spark, sf_dir).select("page_id", "url", F.explode(F.array(*map(F.lit, hrefs))).alias("href"))
    return rows.selectExpr("page_id", "href", f"{U.resolve_url('url', 'href')} AS abs_url")


def same_domain_links(spark, sf_dir):
    return L.same_domain_links(parsed(spark, sf_dir)).select("page_id", "url")


def normalized_urls(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return rows.selectExpr(
        "page_id", f"{U.normalize_url('url')} AS url",
        f"{U.normalize_url('url', strip_tracking=False)} AS tracked_url",
        f"{U.normalize_url('url', include_fragments=True)} AS fragment_url",
        f"{U.normalize_url(repr('mailto:') + ' || url')} AS mail_url")


def url_parts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return rows.selectExpr("page_id", f"{U.split_url('url')} AS p").select(
        "page_id", "p.scheme", "p.netloc", "p.path", "p.query", "p.fragment")


def query_params(spark, sf_dir):
    """Sorted, decoded parameters without tracking, from addresses built out of the event log."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('z=%20', event_id, '&UTM_Source=feed&b=', event_type, '&a=x+y&b=late&gclid=&e=&k') AS query")
    return rows.selectExpr("event_id", f"{U.strip_tracking_params('query')} AS query")


def internal_hosts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", f"{U.hostname('url')} AS host")
    pairs = rows.selectExpr(
        "page_id", "host", "stack(5, 'same', host, 'www', concat('www.', host), 'sub', concat('a.b.', host), "
        "'prefix', concat('x', host), 'parent', regexp_replace(host, '^[^.]*[.]', '')) AS (kind, other)")
    return pairs.selectExpr("page_id", "kind", f"{U.is_internal('other', 'host')} AS is_internal",
                            f"{U.is_internal('host', 'other')} AS is_internal_back")


def link_types(spark, sf_dir):
    """Types of addresses built out of the event log."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type AS text", "concat('https://', if(event_type = 'view', 'm.netflix.com', 'shop.example.org'),"
        " '/', user_id, CASE event_type WHEN 'click' THEN '.PDF' WHEN 'error' THEN '.v1.png' ELSE '' END, '?f=a.zip') AS url")
    found = rows.selectExpr("event_id", "text", f"lower({U.netloc('url')}) AS host", f"lower({U.url_path('url')}) AS path")
    return found.selectExpr("event_id", f"{U.link_type('host', 'path', 'text')} AS link_type",
                            f"{U.is_resource('path')} AS is_resource")


def link_table(spark, sf_dir):
    return links(spark, sf_dir).select(
        "page_id", "url", "text", "title", "is_internal", "is_navigation", "is_resource", "link_type", "follow",
        "rel", "target")


def duplicate_links(spark, sf_dir):
    """Every link twice, the second time with a fragment and another text: the first one counts."""
    rows = pages(spark, sf_dir).withColumn("html", F.expr(
        "regexp_replace(html, '<li><a href=\"([^\"]*)\">', '<li><a href=\"$1/#x\">first</a><a href=\"$1\">')"))
    return L.extract_links(parse_pages(rows)).select("page_id", "url", "text")


def link_attributes(spark, sf_dir):
    """Link texts, rel, target and navigation flags of pages with fuller markup."""
    rows = pages(spark, sf_dir).withColumn("html", F.expr(
        "replace(regexp_replace(html, '>[^<>]*</a>', ' rel=\"Me nofollow\" target=\"_blank\" aria-label=\"L\"> </a>'), "
        "'<nav>', '<nav class=\"Top-MENU\">')"))
    return L.extract_links(parse_pages(rows)).select(
        "page_id", "url", "text", "title", "rel", "target", "is_navigation")


def navigation_ancestors(spark, sf_dir):
    """A link is navigation when one of three ancestors says so; a fourth does not count."""
    near = L.extract_links(parse_pages(rewritten(spark, sf_dir, "<nav>", '<nav id="page-header">')))
    far = L.extract_links(parse_pages(rewritten(spark, sf_dir, "<nav><ul>", '<nav id="page-header"><div><ul>')))
    return near.withColumn("kind", F.lit("near")).unionByName(far.withColumn("kind", F.lit("far"))).groupBy(
        "page_id", "kind").agg(F.count("*").alias("links"), F.count_if("is_navigation").alias("navigation"))


def internal_links(spark, sf_dir):
    return L.internal(links(spark, sf_dir)).select("page_id", "url")


def external_links(spark, sf_dir):
    rows = rewritten(spark, sf_dir, 'href="/e', 'href="https://Other.example.net/e')
    return L.external(L.extract_links(parse_pages(rows))).select("page_id", "url", "link_type")


def content_links(spark, sf_dir):
    return L.content_links(links(spark, sf_dir)).select("page_id", "url")


def resource_links(spark, sf_dir):
    rows = rewritten(spark, sf_dir, 'href="/', 'href="/Files/doc.PDF?q=')
    return L.extract_links(parse_pages(rows)).groupBy("page_id", "is_resource", "link_type").agg(
        F.count("*").alias("n"))


def unique_urls(spark, sf_dir):
    return L.unique_urls(links(spark, sf_dir)).select("url", "page_id")


def hostname_links(spark, sf_dir):
    return L.hostname_links(parsed(spark, sf_dir)).select("page_id", "href", "text", "is_internal")


def followable_links(spark, sf_dir):
    """Links to follow whose page is not stored yet, with the addresses of documents as stored ones."""
    found = shared_links(spark, sf_dir)
    seen = found.filter("text < 'm'").select("url").distinct()
    return L.followable(found, seen).select("page_id", "url")


def public_links(spark, sf_dir):
    return L.public_columns(links(spark, sf_dir)).drop("pos")


def links_per_host(spark, sf_dir):
    """Distinct normalised internal links per host of the page."""
    found = L.internal(links(spark, sf_dir)).selectExpr(f"{U.hostname('page_url')} AS host", "url")
    return found.distinct().groupBy("host").agg(F.count("*").alias("n_links"))


def link_counts(spark, sf_dir):
    return L.link_counts(parsed(spark, sf_dir))


def cut_link_texts(spark, sf_dir):
    """Link texts cut to 200 characters, on pages where every text is longer."""
    longer = rewritten(spark, sf_dir, "</a>", " more" * 60 + "</a>")
    return L.extract_links(parse_pages(longer), max_text=200).select("page_id", "url", "text")


def frontier_outcomes(spark, sf_dir):
    """Which link targets, and which page addresses, are stored pages?"""
    stored = spark.read.parquet(f"{sf_dir}/pages.parquet")
    wanted = L.unique_urls(links(spark, sf_dir)).select("url").unionByName(
        stored.filter("url like '%#top'").select("url"))
    return G.outcomes(wanted, stored)


def enqueued(spark, sf_dir):
    """The queue after new links were added: neither queued nor visited before."""
    found = shared_links(spark, sf_dir)
    queue = found.filter("text < 'd'").select("url").distinct()
    visited = found.filter("text > 't'").select("url").distinct()
    return G.enqueue(queue, found, visited, ["url"])


def domain_gate(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(
        "page_id", "url AS seed", "explode(array(url, replace(url, '://', '://www.'))) AS url")
    return G.domain_gate(rows).select("page_id", "url")


QUERIES = {f.__name__: f for f in (
    absolute_links, relative_links, same_domain_links, normalized_urls, url_parts, query_params, internal_hosts,
    link_types, link_table, duplicate_links, link_attributes, navigation_ancestors, internal_links, external_links,
    content_links, resource_links, unique_urls, hostname_links, followable_links, public_links, links_per_host,
    link_counts, cut_link_texts, frontier_outcomes, enqueued, domain_gate,
)}

_A, _L = "WITH " + O.ANCHORS, "WITH " + O.LINKS
_HOST = "split_part(url, '/', 3)"
_ROOT = "regexp_extract(url, '^[a-z]+://[^/]+', 0)"
_DIR = "regexp_extract(url, '^[^?#]*/', 0)"
_PARENT = "regexp_replace(regexp_extract(url, '^[^?#]*/', 0), '[^/]+/$', '')"

ORACLE = {
    "absolute_links": f"{_A} SELECT page_id, href, abs_url FROM a",
    "relative_links": f"""SELECT page_id, href, CASE href WHEN 'x/y' THEN {_DIR} || 'x/y' WHEN '../x' THEN {_PARENT} || 'x'
        WHEN './x' THEN {_DIR} || 'x' WHEN '?q=1' THEN regexp_extract(url, '^[^?#]*') || '?q=1'
        WHEN '//other.org/p' THEN split_part(url, '/', 1) || '//other.org/p' WHEN '/a/../b' THEN {_ROOT} || '/b'
        ELSE regexp_extract(url, '^[^#]*') || '#f' END AS abs_url
        FROM pages, (SELECT unnest(['x/y', '../x', './x', '?q=1', '//other.org/p', '/a/../b', '#f']) AS href)""",
    "same_domain_links": f"{_A} SELECT DISTINCT page_id, abs_url AS url FROM a",
    "normalized_urls": f"""SELECT page_id, {O.normalized('url')} AS url,
        regexp_replace(regexp_replace(url, '#.*$', ''), '([^/])/+($|\\?)', '\\1\\2') AS tracked_url,
        {O.normalized("regexp_replace(url, '#.*$', '')")} || regexp_extract(url, '#.*$') AS fragment_url,
        CAST(NULL AS VARCHAR) AS mail_url FROM pages""",
    "url_parts": f"""SELECT page_id, split_part(url, ':', 1) AS scheme, {_HOST} AS netloc,
        regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query,
        regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""",
    "query_params": "SELECT event_id, 'a=x y&b=' || event_type || '&e=&k=&z= ' || event_id AS query FROM events",
    "internal_hosts": f"""WITH h AS (SELECT page_id, lower({_HOST}) AS host FROM pages), o AS (
        SELECT page_id, host, 'same' AS kind, host AS other FROM h UNION ALL SELECT page_id, host, 'www', 'www.' || host FROM h
        UNION ALL SELECT page_id, host, 'sub', 'a.b.' || host FROM h UNION ALL SELECT page_id, host, 'prefix', 'x' || host FROM h
        UNION ALL SELECT page_id, host, 'parent', regexp_replace(host, '^[^.]*[.]', '') FROM h)
        SELECT page_id, kind, kind IN ('same', 'www', 'sub') OR (starts_with(host, 'www.') AND kind IN ('parent', 'prefix')) AS is_internal,
        kind IN ('same', 'www', 'parent') AS is_internal_back FROM o""",
    "link_types": """SELECT event_id, CASE event_type WHEN 'view' THEN 'social' WHEN 'click' THEN 'download'
        WHEN 'error' THEN 'media' WHEN 'signup' THEN 'navigation' ELSE 'content' END AS link_type,
        event_type IN ('click', 'error') AS is_resource FROM events""",
    "link_table": f"""{_L} SELECT page_id, norm AS url, text, '' AS title, true AS is_internal, is_navigation,
        is_resource, link_type, true AS follow, '' AS rel, '' AS target FROM l""",
    "duplicate_links": f"{_L} SELECT page_id, norm AS url, 'first' AS text FROM l",
    "link_attributes": f"""{_L} SELECT page_id, norm AS url, 'L' AS text, '' AS title, 'Me' AS rel, '_blank' AS target,
        true AS is_navigation FROM l""",
    "navigation_ancestors": f"""{_L}, n AS (SELECT page_id, count(*) AS links, count(*) FILTER (is_navigation) AS own
        FROM l GROUP BY 1) SELECT page_id, 'near' AS kind, links, links AS navigation FROM n
        UNION ALL SELECT page_id, 'far', links, own FROM n""",
    "internal_links": f"{_L} SELECT page_id, norm AS url FROM l",
    "external_links": f"""{_L} SELECT page_id, 'https://other.example.net' || rtrim(href, '/') AS url, link_type
        FROM l WHERE href LIKE '/e%'""",
    "content_links": f"""{_L} SELECT page_id, norm AS url FROM l WHERE NOT is_navigation AND NOT is_resource
        AND link_type = 'content'""",
    "resource_links": f"{_A} SELECT page_id, true AS is_resource, 'download' AS link_type, count(DISTINCT href) AS n FROM a GROUP BY 1",
    "unique_urls": f"{_L} SELECT norm AS url, min(page_id) AS page_id FROM l GROUP BY 1",
    "hostname_links": f"""{_A} SELECT page_id, abs_url AS href, text, true AS is_internal FROM a
        QUALIFY row_number() OVER (PARTITION BY page_id, abs_url ORDER BY n) = 1""",
    "followable_links": f"""{_L} SELECT page_id, norm AS url FROM l
        WHERE norm NOT IN (SELECT norm FROM l WHERE text < 'm')""",
    "public_links": f"""{_L} SELECT page_id, page_url, norm AS url, text, '' AS title, true AS is_internal,
        is_navigation, is_resource, link_type FROM l""",
    "links_per_host": f"{_L} SELECT lower(host) AS host, count(DISTINCT norm) AS n_links FROM l GROUP BY 1",
    "link_counts": f"""{_L} SELECT page_id, count(*) AS internal_links_count, 0 AS external_links_count FROM l GROUP BY 1""",
    "cut_link_texts": f"""{_L} SELECT page_id, norm AS url, left(ltrim(text || repeat(' more', 60)), 200) AS text FROM l""",
    "frontier_outcomes": f"""{_L}, w AS (SELECT DISTINCT norm AS url FROM l UNION ALL SELECT url FROM pages WHERE url LIKE '%#top')
        SELECT url, {O.normalized('url')} IN (SELECT {O.normalized('url')} FROM pages) AS ok FROM w""",
    "enqueued": f"""{_L} SELECT DISTINCT norm AS url FROM l WHERE text < 'd' UNION
        SELECT norm FROM l WHERE norm NOT IN (SELECT norm FROM l WHERE text > 't')""",
    "domain_gate": "SELECT page_id, url FROM pages",
}

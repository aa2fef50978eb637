"""Queries that crawl the stored pages, order the results and count them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators import annotate as M
from pagewright.operators import crawl as G
from pagewright.operators import links as L
from pagewright.operators import ordering as W
from pagewright.operators import stats as A
from pagewright.plans import oracle as O
from pagewright.plans.link_queries import links, shared_links
from pagewright.plans.page_queries import pages, parsed, records, table
from pagewright.session import scratch_folder
from pagewright.sinks import save as S
from pagewright.sources.pages import spread


def crawl_pages(spark, sf_dir):
    """Every stored page is a start URL; its links are found, most targets are not stored."""
    rows = pages(spark, sf_dir)
    return G.crawl(rows, rows.selectExpr("url AS seed"))


def order_pages(spark, sf_dir):
    """A site derived from the order tables: order -> customer -> nation -> region -> nation 0.

    Each row is one page with one link, so no page grows with the data.
    """
    def page(rows, kind, key, link):
        html = f"concat('<body><h1>{kind} ', {key}, '</h1><p>', repeat('Some words of text. ', 6), '</p><a href=\"', {link}, '\">up</a>')"
        return rows.selectExpr(f"concat('http://shop.example.com/{kind}/', {key}) AS url", f"{html} AS html")

    return spread(
        page(table(spark, sf_dir, "orders"), "order", "o_orderkey", "concat('../customer/', o_custkey, '?ref=o')")
        .unionByName(page(table(spark, sf_dir, "customer"), "customer", "c_custkey", "concat('/nation/', c_nationkey)"))
        .unionByName(page(table(spark, sf_dir, "nation"), "nation", "n_nationkey", "concat('/region/', n_regionkey, '#r')"))
        .unionByName(page(table(spark, sf_dir, "region"), "region", "r_regionkey", "'/nation/0'"))
    )


def _order_seeds(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("concat('http://shop.example.com/order/', o_orderkey) AS seed")


def crawl_orders(spark, sf_dir):
    """Unbounded crawl: raw addresses, so the link with a parameter leads nowhere."""
    return G.crawl(order_pages(spark, sf_dir), _order_seeds(spark, sf_dir))


def bounded_crawl_orders(spark, sf_dir):
    """Bounded crawl with normalised addresses from every order, at most 4 pages and 3 levels."""
    found = G.bounded_crawl(order_pages(spark, sf_dir), _order_seeds(spark, sf_dir), max_pages=4, max_depth=3)
    return found.select("seed", "url", "depth", "ok")


def budget_crawl(spark, sf_dir):
    """Crawl of the customers' orders in key order: a page per customer that links to all nations."""
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat('http://shop.example.com/c/', c_custkey) AS url")
    text = "repeat('Some words of text. ', 6)"
    anchors = "array_join(transform(sequence(0, 29), n -> concat('<a href=\"/n/', n, '\">', n, '</a>')), ' ')"
    site = spread(customers.selectExpr("url", f"concat('<body><p>', {text}, '</p>', {anchors}) AS html").unionByName(
        table(spark, sf_dir, "nation").selectExpr(
            "concat('http://shop.example.com/n/', n_nationkey) AS url", f"concat('<body><p>', {text}, '</p>') AS html")))
    found = G.bounded_crawl(site, customers.selectExpr("url AS seed"), max_pages=10)
    return found.select("seed", "url", "depth", "ok")


def scored_crawl(spark, sf_dir):
    """As `budget_crawl`, but queued by a score that prefers high nation numbers and drops 20."""
    customers = table(spark, sf_dir, "customer").selectExpr("concat('http://shop.example.com/c/', c_custkey) AS url")
    text = "repeat('Some words of text. ', 6)"
    anchors = "array_join(transform(sequence(0, 24), n -> concat('<a href=\"/n/', n, '\">', n, '</a>')), ' ')"
    site = spread(customers.selectExpr("url", f"concat('<body><p>', {text}, '</p>', {anchors}) AS html").unionByName(
        table(spark, sf_dir, "nation").selectExpr(
            "concat('http://shop.example.com/n/', n_nationkey) AS url", f"concat('<body><p>', {text}, '</p>') AS html")))
    scores = customers.selectExpr("url AS page_url", "explode(sequence(15, 24)) AS n").selectExpr(
        "page_url", "concat('http://shop.example.com/n/', n) AS url", "n / 25D AS relevance_score",
        "'content' AS link_type", "n <> 20 AS should_follow")
    found = G.bounded_crawl(site, customers.selectExpr("url AS seed"), max_pages=5, scores=scores)
    return found.select("seed", "url", "depth", "ok")


def linked_site(spark, sf_dir):
    """A site of one page per stored page: links to the next, to page 2k + 1 and to page 3k + 2, and a dead end.

    Stored addresses carry campaign tags, fragments and slashes; links name them as stored,
    canonically, or with another tag.  Every seventh page is too short for the bounded crawl.
    """
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    total = rows.agg(F.max("page_id").alias("_last"))
    site = "concat('http://site.example.com/p/', {0})".format
    stored = "concat({0}, element_at(array('', '?utm_source=x', '#top', '/', ''), cast({1} % 5 + 1 as int)))".format
    link = ("concat('<a href=\"', case t % 3 when 0 then " + stored(site("t"), "t") + " when 1 then " + site("t") + " else concat("
            + site("t") + ", '?utm_medium=m') end, '\">', t, '</a>')")
    targets = "transform(array(page_id + 1, 2 * page_id + 1, 3 * page_id + 2), t -> t % (_last + 1))"
    # One row with the largest page_id.
    return spread(rows.join(F.broadcast(total)).selectExpr(
        "page_id", f"{stored(site('page_id'), 'page_id')} AS url",
        f"concat('<body><p>', repeat('Some words of text. ', if(page_id % 7 = 6, 1, 6)), '</p>', array_join(transform({targets}, t -> {link}), ' '), "
        "' <a href=\"/gone/', page_id, '\">gone</a>') AS html"))


def _site_seeds(site):
    return site.selectExpr("url AS seed")


def site_crawl(spark, sf_dir):
    """Unbounded crawl, three levels deep, from every page of the linked site: addresses as they are."""
    site = linked_site(spark, sf_dir)
    return G.crawl(site, _site_seeds(site), max_depth=3)


def site_bounded_crawl(spark, sf_dir):
    """Bounded crawl from every page of the linked site: 12 pages, 4 levels, canonical addresses."""
    site = linked_site(spark, sf_dir)
    found = G.bounded_crawl(site, _site_seeds(site), max_pages=12, max_depth=4)
    return found.selectExpr("seed", "url", "depth", "ok", "stored")


def crawl_output(spark, sf_dir):
    """Records and statistics of a bounded crawl, saved and read back; model titles for even pages."""
    site = linked_site(spark, sf_dir)
    visited = G.bounded_crawl(site, _site_seeds(site), max_pages=3, max_depth=2)
    notes = site.filter("page_id % 2 = 0").selectExpr(
        "page_id", "concat('Page ', page_id) AS title", "'' AS main_content", "cast(null as string) AS author",
        "'2024-01-01' AS date_published", "'' AS summary", "'page' AS content_type")
    records = G.crawl_records(visited, site, notes).select("seed", "visited_url", "depth", "page_id", "title", "main_content", "content_type")
    path = scratch_folder(spark, "crawl-output")
    S.save_with_stats(records.withColumnRenamed("seed", "url"), A.bounded_stats(visited, duration="2D"), path)
    data = spark.read.schema("url string, record struct<visited_url: string, depth: int, title: string, main_content: string, "
                             "content_type: string>").json(f"{path}/data")
    stats = spark.read.schema("seed string, total_pages_scraped long, failed_urls long").json(f"{path}/stats")
    return data.join(stats, F.col("url") == F.col("seed")).select(
        "seed", "record.visited_url", "record.depth", "record.title", "record.main_content", "record.content_type",
        "total_pages_scraped", "failed_urls")


def crawl_waves(spark, sf_dir):
    """The frontier of all link targets in waves of 16."""
    frontier = L.unique_urls(links(spark, sf_dir)).select("url")
    return W.waves(frontier, ["url"], 16)


def politeness_schedule(spark, sf_dir):
    """Start second of each page fetch with a fixed delay of 1.5 s per host."""
    frontier = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(
        "url", f"{U.hostname('url')} AS host", "0 AS depth")
    return W.schedule(frontier, 1.5, 1.5).select("url", "host", "starts_after")


def numbered_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return W.number_rows(rows, ["url"], "number")


def numbered_turns(spark, sf_dir):
    """1-based numbers over all turns of all conversations."""
    return W.number_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])


def first_turns(spark, sf_dir):
    """The first turn per role over the whole table, and per conversation."""
    return W.first_per_key(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text"),
                           ["conv_id", "role"], ["turn"])


def scored_links(spark, sf_dir):
    return _scored(links(spark, sf_dir))


def _scored(found):
    """Links with a score derived from the length of their text."""
    return found.selectExpr(
        "page_id", "page_url", "pos", "url", "text", "link_type", "follow",
        "(length(text) % 7) / 8D AS relevance_score", "length(text) % 3 AS priority")


def links_by_relevance(spark, sf_dir):
    """Place of each link of a page: by relevance, and by relevance and priority."""
    return scored_links(spark, sf_dir).selectExpr(
        "page_id", "url", "relevance_score",
        "row_number() OVER (PARTITION BY page_id ORDER BY relevance_score DESC, pos) AS place",
        "row_number() OVER (PARTITION BY page_id ORDER BY relevance_score DESC, priority, pos) AS priority_place")


def most_relevant_links(spark, sf_dir):
    """All links, most relevant first."""
    return W.by_relevance(scored_links(spark, sf_dir), priority=True).select(
        "page_id", "url", "relevance_score", "priority")


def top_links(spark, sf_dir):
    return L.extract_links(parsed(spark, sf_dir), top=3).select("page_id", "url")


def merged_scores(spark, sf_dir):
    """Links whose text is long take the type and the follow flag of their score."""
    found = shared_links(spark, sf_dir)
    scores = _scored(found).filter("relevance_score > 0.5").selectExpr(
        "page_url", "url", "relevance_score", "'scored' AS link_type", "priority <> 0 AS should_follow")
    return M.merge_scores(found, scores).select("page_id", "url", "link_type", "follow", "relevance_score")


def crawl_stats(spark, sf_dir):
    visited = G.crawl(pages(spark, sf_dir), pages(spark, sf_dir).selectExpr("url AS seed"), urls=False)
    return A.crawl_stats(visited)


def total_crawl_stats(spark, sf_dir):
    visited = G.crawl(pages(spark, sf_dir), pages(spark, sf_dir).selectExpr("url AS seed"), urls=False)
    return A.crawl_stats(visited, by=[])


def bounded_stats(spark, sf_dir):
    visited = G.bounded_crawl(order_pages(spark, sf_dir), _order_seeds(spark, sf_dir), max_pages=4, max_depth=3, urls=False)
    return A.bounded_stats(visited, duration="75.5D")


def export_stats_of_crawl(spark, sf_dir):
    """The same statistics in the export layout."""
    return A.to_export_stats(bounded_stats(spark, sf_dir))


def export_stats(spark, sf_dir):
    """Per host: pages long enough, links found, load and size."""
    found = records(spark, sf_dir).selectExpr(
        f"{U.hostname('url')} AS host", "length(main_content) >= 1000 AS ok", "length(text) AS n")
    by_host = links(spark, sf_dir).selectExpr(f"{U.hostname('page_url')} AS host", "text > 'm' AS follow")
    return A.export_stats(found, ["host"], by_host, size="n", load_time="n / 4D").select(
        "host", "total_pages", "successful_pages", "failed_pages", "success_rate", "total_links_found",
        "total_links_followed", "avg_load_time_ms", "total_bytes_downloaded")


QUERIES = {f.__name__: f for f in (
    crawl_pages, crawl_orders, bounded_crawl_orders, budget_crawl, scored_crawl, site_crawl, site_bounded_crawl, crawl_output, crawl_waves, politeness_schedule,
    numbered_pages, numbered_turns, first_turns, links_by_relevance, most_relevant_links, top_links, merged_scores,
    crawl_stats, total_crawl_stats, bounded_stats, export_stats_of_crawl, export_stats,
)}

_L = "WITH " + O.LINKS
_VISITED = O.ANCHORS + """,
v AS (SELECT page_url AS seed, abs_url AS url, 1 AS depth FROM a WHERE abs_url <> page_url GROUP BY ALL
  UNION ALL SELECT url, url, 0 FROM pages),
v2 AS (SELECT *, url IN (SELECT url FROM pages) AS ok FROM v)"""
# order -> customer -> nation -> region -> nation 0 -> region 0, each address once
_CHAIN = """o AS (SELECT 'http://shop.example.com/' AS site, o_orderkey, o_custkey, n_nationkey, n_regionkey FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT site || 'order/' || o_orderkey AS seed, site || 'order/' || o_orderkey AS url, 0 AS depth FROM o
  UNION ALL SELECT site || 'order/' || o_orderkey, site || 'customer/' || o_custkey, 1 FROM o
  UNION ALL SELECT site || 'order/' || o_orderkey, site || 'nation/' || n_nationkey, 2 FROM o
  UNION ALL SELECT site || 'order/' || o_orderkey, site || 'region/' || n_regionkey, 3 FROM o)"""
# the linked site: pages with their links in order
_SITE = """last AS (SELECT max(page_id) AS m FROM pages),
s AS (SELECT page_id AS id, 'http://site.example.com/p/' || page_id AS clean, page_id % 7 <> 6 AS long_enough, m + 1 AS n FROM pages, last),
s2 AS (SELECT *, clean || ['', '?utm_source=x', '#top', '/', ''][id % 5 + 1] AS stored FROM s),
e AS (SELECT id, n, i, [id + 1, 2 * id + 1, 3 * id + 2][i] % n AS t FROM s2, (SELECT unnest([1, 2, 3]) AS i)),
e2 AS (SELECT id, i, t, 'http://site.example.com/p/' || t AS clean FROM e),
h AS (SELECT id, i, t, clean, CASE t % 3 WHEN 0 THEN clean || ['', '?utm_source=x', '#top', '/', ''][t % 5 + 1]
  WHEN 1 THEN clean ELSE clean || '?utm_medium=m' END AS raw FROM e2
  UNION ALL SELECT id, 4, NULL, 'http://site.example.com/gone/' || id, 'http://site.example.com/gone/' || id FROM s2)"""
# every path of the breadth-first search; the first place of an address is its smallest
_BOUNDED = """, w AS (SELECT stored AS seed, stored AS url, id, 0 AS depth, []::INTEGER[] AS place FROM s2
  UNION ALL SELECT w.seed, h.clean, h.t, w.depth + 1, list_append(w.place, h.i) FROM w JOIN s2 ON s2.id = w.id AND s2.long_enough
    JOIN h ON h.id = w.id WHERE w.depth < {depth}),
f AS (SELECT seed, url, min(depth) AS depth, arg_min(place, (depth, place)) AS place, any_value(id) AS id FROM w GROUP BY seed, url),
g AS (SELECT f.*, s2.stored, coalesce(s2.long_enough, false) AS ok FROM f LEFT JOIN s2 ON s2.id = f.id),
v AS (SELECT *, coalesce(sum(ok::INTEGER) OVER (PARTITION BY seed ORDER BY depth, place
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM g QUALIFY done < {pages})"""
_RATE = "printf('%.1f%%', count(*) FILTER (ok) * 100.0 / count(*))"
_WORDS = "(SELECT *, (length(text) % 7) / 8.0 AS relevance_score, length(text) % 3 AS priority FROM l)"
_H_SQL = "lower(split_part(url, '/', 3))"

ORACLE = {
    "crawl_pages": f"WITH {_VISITED} SELECT seed, url, depth, ok FROM v2",
    "crawl_orders": """SELECT 'http://shop.example.com/order/' || o_orderkey AS seed,
        'http://shop.example.com/order/' || o_orderkey AS url, 0 AS depth, true AS ok FROM orders UNION ALL
        SELECT 'http://shop.example.com/order/' || o_orderkey,
        'http://shop.example.com/customer/' || o_custkey || '?ref=o', 1, false FROM orders""",
    "bounded_crawl_orders": f"WITH {_CHAIN} SELECT seed, url, depth, true AS ok FROM c",
    "budget_crawl": """SELECT 'http://shop.example.com/c/' || c_custkey AS seed,
        'http://shop.example.com/' || CASE WHEN n = -1 THEN 'c/' || c_custkey ELSE 'n/' || n END AS url,
        CASE WHEN n = -1 THEN 0 ELSE 1 END AS depth, true AS ok FROM customer, (SELECT unnest(range(-1, 9)) AS n)""",
    "scored_crawl": """SELECT 'http://shop.example.com/c/' || c_custkey AS seed,
        'http://shop.example.com/' || CASE WHEN n = -1 THEN 'c/' || c_custkey ELSE 'n/' || n END AS url,
        CASE WHEN n = -1 THEN 0 ELSE 1 END AS depth, true AS ok FROM customer, (SELECT unnest([-1, 24, 23, 22, 21]) AS n)""",
    "site_crawl": f"""WITH RECURSIVE {_SITE}, w AS (SELECT stored AS seed, stored AS url, 0 AS depth FROM s2
        UNION SELECT w.seed, h.raw, w.depth + 1 FROM w JOIN s2 ON s2.stored = w.url JOIN h ON h.id = s2.id WHERE w.depth < 3)
        SELECT seed, url, min(depth) AS depth, url IN (SELECT stored FROM s2) AS ok FROM w GROUP BY seed, url""",
    "site_bounded_crawl": f"WITH RECURSIVE {_SITE}{_BOUNDED.format(depth=4, pages=12)} SELECT seed, url, depth, ok, stored FROM v",
    "crawl_output": f"""WITH RECURSIVE {_SITE}{_BOUNDED.format(depth=2, pages=3)},
        c AS (SELECT seed, count(*) FILTER (ok) AS total_pages_scraped, count(*) FILTER (NOT ok) AS failed_urls FROM v GROUP BY seed)
        SELECT seed, url AS visited_url, depth, CASE WHEN v.id % 2 = 0 THEN 'Page ' || v.id ELSE '' END AS title,
        rtrim(repeat('Some words of text. ', 6)) || ' ' || ((v.id + 1) % n) || ' ' || ((2 * v.id + 1) % n) || ' ' || ((3 * v.id + 2) % n) || ' gone' AS main_content,
        CASE WHEN v.id % 2 = 0 THEN 'page' ELSE 'unknown' END AS content_type, total_pages_scraped, failed_urls
        FROM v JOIN c USING (seed) JOIN s2 ON s2.id = v.id WHERE ok""",
    "crawl_waves": f"""{_L} SELECT norm AS url, (row_number() OVER (ORDER BY norm) - 1) // 16 AS wave
        FROM (SELECT DISTINCT norm FROM l)""",
    "politeness_schedule": f"""SELECT url, {_H_SQL} AS host,
        (row_number() OVER (PARTITION BY {_H_SQL} ORDER BY url) - 1) * 1.5::DOUBLE AS starts_after FROM pages""",
    "numbered_pages": "SELECT page_id, url, row_number() OVER (ORDER BY url) AS number FROM pages",
    "numbered_turns": "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS number FROM conversations",
    "first_turns": """SELECT conv_id, role, turn, text FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1""",
    "links_by_relevance": f"""{_L} SELECT page_id, norm AS url, relevance_score::DOUBLE AS relevance_score,
        row_number() OVER (PARTITION BY page_id ORDER BY relevance_score DESC, n) AS place,
        row_number() OVER (PARTITION BY page_id ORDER BY relevance_score DESC, priority, n) AS priority_place FROM {_WORDS}""",
    "most_relevant_links": f"""{_L} SELECT page_id, norm AS url, relevance_score::DOUBLE AS relevance_score, priority
        FROM {_WORDS}""",
    "top_links": f"{_L} SELECT page_id, norm AS url FROM l QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n) <= 3",
    "merged_scores": f"""{_L} SELECT page_id, norm AS url, CASE WHEN relevance_score > 0.5 THEN 'scored' ELSE link_type END
        AS link_type, relevance_score <= 0.5 OR priority <> 0 AS follow,
        CASE WHEN relevance_score > 0.5 THEN relevance_score ELSE 0.5 END::DOUBLE AS relevance_score FROM {_WORDS}""",
    "crawl_stats": f"""WITH {_VISITED} SELECT seed, count(*) FILTER (ok) AS total_pages_scraped,
        count(*) AS total_urls_processed, count(*) FILTER (NOT ok) AS failed_urls, {_RATE} AS success_rate,
        'table' AS fetch_mode FROM v2 GROUP BY seed""",
    "total_crawl_stats": f"""WITH {_VISITED} SELECT count(*) FILTER (ok) AS total_pages_scraped,
        count(*) AS total_urls_processed, count(*) FILTER (NOT ok) AS failed_urls, {_RATE} AS success_rate,
        'table' AS fetch_mode FROM v2""",
    "bounded_stats": f"""WITH {_CHAIN} SELECT seed, count(*) AS total_pages_scraped, count(*) AS total_urls_visited,
        0 AS failed_urls, 75.5::DOUBLE AS duration_seconds, '1 minutes' AS duration_formatted,
        '100.0%' AS success_rate FROM c GROUP BY seed""",
    "export_stats_of_crawl": f"""WITH {_CHAIN} SELECT count(*) AS total_pages, count(*) AS successful_pages,
        0 AS failed_pages, '100.0%' AS success_rate, 0 AS total_links_found, 0 AS total_links_followed,
        '' AS start_time, '' AS end_time, 75.5::DOUBLE AS duration_seconds, '1.3 minutes' AS duration_formatted,
        seed AS start_url, 'shop.example.com' AS domain, 0::DOUBLE AS avg_load_time_ms, 0 AS total_bytes_downloaded,
        CAST(NULL AS VARCHAR) AS llm_provider, 0 AS llm_calls FROM c GROUP BY seed""",
    "export_stats": f"""{_L}, r AS (SELECT {_H_SQL} AS host, length({O.text('article', ' ')}) >= 1000 AS ok,
        length({O.collapsed(O.text('clean', ' '))}) AS n FROM p),
        k AS (SELECT lower(host) AS host, count(*) AS found, count(*) FILTER (text > 'm') AS followed FROM l GROUP BY 1)
        SELECT host, count(*) AS total_pages, count(*) FILTER (ok) AS successful_pages,
        count(*) FILTER (NOT ok) AS failed_pages, {_RATE} AS success_rate, coalesce(any_value(found), 0) AS total_links_found,
        coalesce(any_value(followed), 0) AS total_links_followed, avg(n / 4.0)::DOUBLE AS avg_load_time_ms,
        sum(n)::BIGINT AS total_bytes_downloaded FROM r LEFT JOIN k USING (host) GROUP BY host""",
}

"""Crawls against a plain breadth-first search, ordering, statistics and sources."""

import random
from collections import deque

from pyspark.sql import functions as F

from pagewright.operators import crawl as G
from pagewright.operators import ordering as W
from pagewright.operators import stats as A
from pagewright.sources import pages as S

HOST = "http://site.example.com"
BODY = "<body><p>" + "words " * 30 + "</p>"


def site(spark, graph, short=()):
    rows = [(i, url, ("<body>" if url in short else BODY) + "".join(f'<a href="{t}">l</a>' for t in targets))
            for i, (url, targets) in enumerate(graph.items())]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def seeds(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "seed string")


def random_graph(rnd, n):
    urls = [f"{HOST}/p{i}" for i in range(n)]
    graph = {}
    for url in urls:
        if rnd.random() < 0.85:
            graph[url] = [rnd.choice(urls) if rnd.random() < 0.9 else "http://other.example.com/x"
                          for _ in range(rnd.randint(0, 5))]
    return graph


def search(graph, seed, max_pages=None, max_depth=None, short=()):
    """One queue, one page at a time."""
    queue, tried, done = deque([(seed, 0)]), {}, 0
    while queue and (max_pages is None or done < max_pages):
        url, depth = queue.popleft()
        if url in tried or (max_depth is not None and depth > max_depth) or not url.startswith(HOST + "/"):
            continue
        ok = url in graph and url not in short
        tried[url] = (depth, ok)
        done += ok
        if ok:
            queue.extend((t, depth + 1) for t in dict.fromkeys(graph[url]))
    return tried


def found(rows):
    result = {}
    for r in rows.collect():
        result.setdefault(r.seed, {})[r.url] = (r.depth, r.ok)
    return result


def test_unbounded_crawl_equals_plain_search(spark):
    graph = random_graph(random.Random(1), 60)
    starts = [f"{HOST}/p{i}" for i in range(0, 60, 7)]
    crawled = found(G.crawl(site(spark, graph), seeds(spark, *starts)))
    assert crawled == {s: search(graph, s) for s in starts}


def test_bounded_crawl_equals_plain_search(spark):
    graph = random_graph(random.Random(2), 60)
    short = {f"{HOST}/p{i}" for i in range(0, 60, 9)}
    starts = [f"{HOST}/p{i}" for i in range(0, 60, 11)]
    for max_pages, max_depth in ((6, 5), (100, 2), (1, 5)):
        crawled = found(G.bounded_crawl(site(spark, graph, short), seeds(spark, *starts), max_pages, max_depth))
        assert crawled == {s: search(graph, s, max_pages, max_depth, short) for s in starts}


def test_hot_addresses_are_spread(spark):
    graph = random_graph(random.Random(5), 40)
    for url in graph:
        graph[url] = [f"{HOST}/p0", *graph[url]]
    graph[f"{HOST}/p0"] = [f"{HOST}/p{i}" for i in range(6)]
    starts = [f"{HOST}/p{i}" for i in range(40)]
    pages = site(spark, graph)
    assert found(G.crawl(pages, seeds(spark, *starts))) == {s: search(graph, s) for s in starts}
    assert found(G.bounded_crawl(pages, seeds(spark, *starts), 7, 4)) == {
        s: search(graph, s, 7, 4) for s in starts}


def test_equal_keys_are_numbered_once(spark):
    rows = spark.range(2000).selectExpr("1 AS k", "id")
    assert sorted(r.number for r in W.number_rows(rows, ["k"]).collect()) == list(range(1, 2001))


def test_cycle_diamond_and_depth(spark):
    chain = {f"{HOST}/c{i}": [f"{HOST}/c{i + 1}"] for i in range(8)}
    graph = {f"{HOST}/a": [f"{HOST}/b", f"{HOST}/d"], f"{HOST}/b": [f"{HOST}/e"], f"{HOST}/d": [f"{HOST}/e"],
             f"{HOST}/e": [f"{HOST}/a"], **chain}
    pages = site(spark, graph)
    crawled = found(G.bounded_crawl(pages, seeds(spark, f"{HOST}/a", f"{HOST}/c0")))
    assert {u: d for u, (d, _) in crawled[f"{HOST}/a"].items()} == {
        f"{HOST}/a": 0, f"{HOST}/b": 1, f"{HOST}/d": 1, f"{HOST}/e": 2}
    assert len(crawled[f"{HOST}/c0"]) == 6
    unbounded = found(G.crawl(pages, seeds(spark, f"{HOST}/c0")))[f"{HOST}/c0"]
    assert unbounded[f"{HOST}/c8"] == (8, False) and len(unbounded) == 9
    assert len(found(G.crawl(pages, seeds(spark, f"{HOST}/c0"), max_depth=3))[f"{HOST}/c0"]) == 4


def test_a_page_stored_many_times_is_one_page(spark):
    pages = site(spark, {f"{HOST}/a": [f"{HOST}/b"], f"{HOST}/b": []})
    copies = pages.unionByName(spark.range(100, 400).selectExpr(
        "id AS page_id", f"'{HOST}/a' AS url", f"'{BODY}<a href=\"/z\">z</a>' AS html"))
    crawled = found(G.crawl(copies, seeds(spark, f"{HOST}/a")))[f"{HOST}/a"]
    assert crawled == {f"{HOST}/a": (0, True), f"{HOST}/b": (1, True)}


def test_scores_order_the_queue_and_can_drop_links(spark):
    graph = {f"{HOST}/a": [f"{HOST}/x", f"{HOST}/y", f"{HOST}/z", f"{HOST}/w"]}
    graph |= {f"{HOST}/{c}": [] for c in "xyzw"}
    scores = spark.createDataFrame([
        (f"{HOST}/a", f"{HOST}/z", 0.9, "content", True), (f"{HOST}/a", f"{HOST}/x", 0.1, "content", True),
        (f"{HOST}/a", f"{HOST}/y", 0.8, "content", False)],
        "page_url string, url string, relevance_score double, link_type string, should_follow boolean")
    rows = G.bounded_crawl(site(spark, graph), seeds(spark, f"{HOST}/a"), max_pages=3, scores=scores)
    assert [r.url[-1] for r in rows.orderBy("depth", "place").collect()] == ["a", "z", "w"]


def test_numbers_and_offsets_with_one_hot_group(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('h', id % 50)) AS host", "id % 7 AS depth")
    numbers = W.number_rows(rows, ["depth", "id"]).collect()
    in_order = sorted(numbers, key=lambda r: (r.depth, r.id))
    assert [r.number for r in in_order] == list(range(1, 5001))
    offsets = W.running_offsets(rows, ["host"], ["depth", "id"], F.col("id") + 1, "before").collect()
    sums = {}
    for r in sorted(offsets, key=lambda r: (r.depth, r.id)):
        assert r.before == sums.get(r.host, 0)
        sums[r.host] = sums.get(r.host, 0) + r.id + 1


def test_waves_and_schedule(spark):
    rows = spark.range(100).selectExpr("concat('http://h', id % 3, '/', id) AS url", "concat('h', id % 3) AS host",
                                       "0 AS depth")
    sizes = W.waves(rows, ["url"], 8).groupBy("wave").count().collect()
    assert sorted((r.wave, r["count"]) for r in sizes) == [(i, 8) for i in range(12)] + [(12, 4)]
    planned = W.schedule(rows, 0.0, 0.0).collect()
    assert sorted(round(r.starts_after, 6) for r in planned if r.host == "h0") == [
        round(0.1 * i, 6) for i in range(34)]
    free = W.schedule(rows, 1.0, 3.0).collect()
    assert all(1.0 <= r.delay < 3.0 for r in free)


def test_crawl_statistics(spark):
    visited = spark.createDataFrame([("a", "u", True), ("a", "v", False), ("a", "w", True), ("b", "x", False)],
                                    "seed string, url string, ok boolean")
    rows = {r.seed: r for r in A.crawl_stats(visited).collect()}
    assert (rows["a"].total_pages_scraped, rows["a"].failed_urls, rows["a"].success_rate) == (2, 1, "66.7%")
    assert rows["b"].success_rate == "0.0%"
    nothing = A.crawl_stats(visited.filter("false"), by=[]).collect()[0]
    assert (nothing.total_urls_processed, nothing.success_rate) == (0, "0%")
    bounded = {r.seed: r for r in A.bounded_stats(visited, duration="3725.128D").collect()}
    assert (bounded["a"].success_rate, bounded["b"].success_rate) == ("100.0%", "0%")
    assert (bounded["a"].duration_seconds, bounded["a"].duration_formatted) == (3725.13, "1.0 hours")
    export = A.to_export_stats(A.bounded_stats(visited.withColumn("seed", F.lit("http://H:1/x")))).collect()[0]
    assert (export.domain, export.success_rate, export.duration_formatted) == ("H:1", "100.0%", "0.0 seconds")


def test_fetch_outcomes(spark):
    attempts = spark.createDataFrame(
        [("a", 1, 500), ("a", 2, 200), ("a", 3, 200), ("b", 1, 404), ("b", 2, 500), ("b", 3, 503), ("b", 4, 200),
         ("c", 1, 399)], "url string, attempt int, status int")
    rows = {r.url: (r.attempts_made, r.succeeded, r.status)
            for r in S.fetch_outcomes(attempts, payload=["status"]).collect()}
    assert rows == {"a": (2, True, 200), "b": (3, False, None), "c": (1, True, 399)}
    assert S.ok_status(attempts).count() == 4 and S.ok_status(attempts, strict=True).count() == 3


def test_document_kind_and_challenge_pages(spark):
    rows = spark.createDataFrame(
        [("http://x/a.xml", None, "<p>"), ("http://x/a.XML", "text/html", "<p>"), ("http://x/a", "Application/RSS+XML", ""),
         ("http://x/b", None, " \n <?xml v"), ("http://x/c", None, "<title>Just A Moment</title>"),
         ("http://x/d", None, None)], "url string, content_type string, html string")
    kinds = rows.select(S.document_kind("url").alias("a"), S.document_kind("url", "content_type").alias("b"),
                        S.document_kind("url", html="html").alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in kinds] == [
        ("xml", "xml", "xml"), ("html", "html", "xml"), ("html", "xml", "html"), ("html", "html", "xml"),
        ("html", "html", "html"), ("html", "html", "html")]
    assert [r.url[-1] for r in S.drop_challenge_pages(rows).collect()] == ["l", "L", "a", "b", "d"]


def test_numbers_do_not_depend_on_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 100)
    try:
        rows = W.number_rows(spark.range(2000), ["id"]).collect()
        within = W.number_within(spark.range(900).selectExpr("id % 3 AS g", "id"), "g", ["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted((r.id, r.number) for r in rows) == [(i, i + 1) for i in range(2000)]
    assert all(r.number == r.id // 3 for r in within)


def test_bounded_crawl_finds_pages_by_canonical_address(spark):
    pages = site(spark, {f"{HOST}/a": ["/b/?utm_source=x", "/c#t", "/gone"], f"{HOST}/b/?utm_source=y": [], f"{HOST}/c#top": []})
    rows = {r.url: (r.ok, r.stored) for r in G.bounded_crawl(pages, seeds(spark, f"{HOST}/a")).collect()}
    assert rows == {f"{HOST}/a": (True, f"{HOST}/a"), f"{HOST}/b": (True, f"{HOST}/b/?utm_source=y"),
                    f"{HOST}/c": (True, f"{HOST}/c#top"), f"{HOST}/gone": (False, None)}
    records = G.crawl_records(G.bounded_crawl(pages, seeds(spark, f"{HOST}/a")), pages).collect()
    assert sorted((r.visited_url, r.url, r.depth) for r in records) == [
        (f"{HOST}/a", f"{HOST}/a", 0), (f"{HOST}/b", f"{HOST}/b/?utm_source=y", 1), (f"{HOST}/c", f"{HOST}/c#top", 1)]


def test_a_budget_that_ends_with_a_success_drops_later_failures(spark):
    pages = site(spark, {f"{HOST}/a": ["/b", "/x", "/y"], f"{HOST}/b": []})
    rows = G.bounded_crawl(pages, seeds(spark, f"{HOST}/a"), max_pages=2).collect()
    assert sorted(r.url for r in rows) == [f"{HOST}/a", f"{HOST}/b"]
    assert G.bounded_crawl(pages, seeds(spark, f"{HOST}/a").limit(0)).count() == 0


def test_crawls_that_are_only_counted_look_up_no_urls(spark):
    text = "Some words of text. " * 6
    site = spark.createDataFrame(
        [("http://h/a", f'<p>{text}</p><a href="b">b</a><a href="/gone?utm_source=x">g</a>'), ("http://h/b", f'<p>{text}</p><a href="a">a</a>'),
         ("http://h/b", f"<p>{text}</p>"), (None, "<p>x</p>")], "url string, html string")
    seeds = spark.createDataFrame([("http://h/a",), ("http://h/b",), ("http://h/none",)], "seed string")
    for crawl, columns in ((G.crawl, ["seed", "depth", "ok"]), (G.bounded_crawl, ["seed", "depth", "place", "ok"])):
        whole, counted = crawl(site, seeds), crawl(site, seeds, urls=False)
        assert counted.columns == columns
        assert sorted(map(str, counted.collect())) == sorted(map(str, whole.select(*columns).collect()))
        joins = [d._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") for d in (whole, counted)]
        assert joins == [2, 1]

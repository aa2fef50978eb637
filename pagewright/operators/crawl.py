"""Breadth-first crawls over a table of stored pages, for many start URLs at once.

The link graph is built once (one parse of the pages, no html is shuffled).  Its addresses become
numbers, and every link carries whether its target is a page that counts, so a level is made of
longs: the frontier meets the links of its pages, new pairs of start and address are what the
visited ones don't hold, and they are appended.

Visited pairs are a table in buckets by start and address.  A level is hashed the same way, so it
finds the pairs that it has to be compared with where they are: only the frontier is shuffled,
however many levels came before, and a start URL over a large site is many buckets.  Joins with
the links are left to the optimiser: it broadcasts a small frontier, and splits the rows of a
page that very many crawls reach at once.  Every level is written to the shared scratch
folder, which cuts lineage and survives the loss of executors.  The driver only sees row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagewright.functions.core import Sql, keep, let
from pagewright.functions.urls import netloc, normalize_url
from pagewright.operators.addresses import Addresses
from pagewright.operators.annotate import merge_annotations, merge_scores
from pagewright.operators.content import extract_pages, main_content, with_clean_tree
from pagewright.operators.links import with_same_domain_targets, with_targets
from pagewright.operators.ordering import number_within
from pagewright.session import scratch_folder, written
from pagewright.sources.parse import parse_pages

MIN_CONTENT_LENGTH = 100


def canonical(url: str) -> str:
    """The address a page is found by; addresses without a canonical form stand for themselves."""
    return f"coalesce({normalize_url(url)}, {url})"


def _parsed(pages: DataFrame) -> DataFrame:
    wanted = [c for c in ("page_id", "url", "html") if c in pages.columns]
    return parse_pages(pages.select(*wanted))


def _first_version(rows: DataFrame) -> DataFrame:
    """One row per URL: the version with the lowest id, however often a URL was stored."""
    rest = F.struct(*[c for c in rows.columns if c not in ("url", "page_id")])
    first = F.min_by(rest, "page_id") if "page_id" in rows.columns else F.min(rest)
    return rows.groupBy("url").agg(first.alias("_v")).select("url", "_v.*")


def link_graph(pages: DataFrame) -> DataFrame:
    """Rows (url, ok, targets) for the unbounded crawl.

    All pages such a crawl reaches share the authority of the start URL, so the domain
    filter applies here, inside the row, before anything is joined.
    """
    found = with_same_domain_targets(_parsed(pages))
    return _first_version(found.select(
        *[c for c in ("page_id",) if c in found.columns], "url", F.lit(True).alias("ok"), "targets"))


def ranked_link_graph(pages: DataFrame, same_domain: bool = True, scores: DataFrame | None = None,
                      min_content_length: int = MIN_CONTENT_LENGTH, remove_noise: bool = True) -> DataFrame:
    """Rows (url, stored, ok, targets) for the bounded crawl; targets in the order they are queued.

    ``url`` is the canonical address, by which links find pages; ``stored`` is the address of
    the version with the lowest id.  C3: with scores (page_url, url, relevance_score, link_type, should_follow) links are
    queued by relevance, highest first, 0.5 where there is no score.
    """
    found = with_targets(with_clean_tree(_parsed(pages), remove_noise))
    content = main_content("_elements", "_strings")
    targets = let(netloc("url"), lambda host: keep("_targets", lambda x: f"{netloc(x)} = {host}")) if same_domain else "_targets"
    ids = [c for c in ("page_id",) if c in found.columns]
    graph = _first_version(found.selectExpr(
        *ids, f"{canonical('url')} AS url", "url AS stored",
        f"(parse_error is null and length({content}) >= {min_content_length}) AS ok",
        f"{targets} AS targets"))
    if scores is None:
        return graph
    queued = graph.selectExpr("stored AS page_url", "posexplode(targets) AS (pos, url)", "'content' AS link_type",
                              "true AS follow")
    # The links of one page came out of one row, so they fit into one again.
    ranked = merge_scores(queued, scores).filter("follow").groupBy("page_url").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("relevance_score")).alias("_order"), "pos", "url"))).alias("_links"))
    return graph.select("url", "stored", "ok").join(ranked.withColumnRenamed("page_url", "stored"), "stored", "left").selectExpr(
        "url", "stored", "ok", "coalesce(_links.url, cast(array() as array<string>)) AS targets")


class _Visited:
    """Pairs of start and address with their levels, in buckets by both.

    A level's files lie in a folder of their own below one table; the table is taken off the catalog at the end,
    its files stay.
    """

    def __init__(self, spark, columns: str):
        self.spark, self.schema = spark, f"seed long, url long, {columns}, depth int"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = scratch_folder(spark, "visited")
        self.name = "visited_" + self.folder.rpartition("-")[2]

    def add(self, rows: DataFrame, depth: int) -> int:
        """Append a level and return its size, as the write counted it.

        The first is dealt like the buckets, as later ones already are; else every task would write a file for each bucket.
        """
        seen = Observation()
        dealt = rows if depth else rows.repartition(self.buckets, "seed", "url")
        dealt.withColumn("depth", F.lit(depth)).observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("depth").bucketBy(
            self.buckets, "seed", "url").option("path", self.folder).mode("append").saveAsTable(self.name)
        return seen.get["n"]

    def new(self, found: DataFrame) -> DataFrame:
        """The rows of `found`, one per pair, that are not in the table."""
        return found.join(self.spark.table(self.name).select("seed", "url"), ["seed", "url"], "left_anti")

    def level(self, depth: int) -> DataFrame:
        return self.spark.table(self.name).where(F.col("depth") == depth)

    def close(self) -> DataFrame:
        """All levels, as files."""
        self.drop()
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class _Network:
    """A link graph in numbers.

    `pages` has page and ok; `links` has page, n (place in its page's queue), url and ok of every link of
    a page that counts; `names` has number, address and, where it is a page, stored.
    """

    def __init__(self, graph: DataFrame, seeds: DataFrame, keys: Sql = "seed"):
        spark = graph.sparkSession
        stored = "stored" if "stored" in graph.columns else "url"
        graph = written(graph, "graph")
        # Canonical addresses cost time, so few small files of seeds must not mean few tasks.
        spread_out = seeds.select("seed").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seed").distinct()
        seeds = written(spread_out.selectExpr("seed", f"{keys} AS key"), "seeds")
        nothing = "cast(null as string)"
        addresses = Addresses(
            graph.selectExpr("url AS address", f"{stored} AS stored")
            .unionAll(graph.selectExpr("explode(targets) AS address", f"{nothing} AS stored"))
            .unionAll(seeds.selectExpr("explode(array(seed, key)) AS address", f"{nothing} AS stored")))
        number = addresses.number
        self.pages = graph.selectExpr(f"{number('url')} AS page", "ok")
        links = graph.where("ok").selectExpr(f"{number('url')} AS page", "posexplode(targets) AS (n, target)").selectExpr(
            "page", "n", f"{number('target')} AS url")
        known = self.pages.withColumnRenamed("page", "url")
        self.links = written(links.join(known, "url", "left").select("page", "n", "url", F.coalesce("ok", F.lit(False)).alias("ok")), "links")
        self.names = addresses.table
        self.starts = seeds.selectExpr(f"{number('seed')} AS seed", f"{number('key')} AS page").join(self.pages, "page", "left").selectExpr(
            "seed", "seed AS url", "page", "coalesce(ok, false) AS ok")

    def named(self, visited: DataFrame, *columns: str, urls: bool = True) -> DataFrame:
        """Rows of seed, page and depth with names for numbers: seed, url, the columns, and the stored address.

        Without `urls` only starts are looked up.
        """
        by_seed = self.names.selectExpr("number AS seed", "address AS seed_name")
        if not urls:
            return visited.join(by_seed, "seed", "left").selectExpr("seed_name AS seed", *columns)
        by_page = self.names.selectExpr("number AS page", "address AS page_name", "stored")
        return visited.join(by_seed, "seed", "left").join(by_page, "page", "left").selectExpr(
            "seed_name AS seed", "if(depth = 0, seed_name, page_name) AS url", *columns, "stored")


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int | None = None, urls: bool = True) -> DataFrame:
    """Every URL reachable on the domain of its start URL.

    `seeds` has a column ``seed``.  Result: (seed, url, depth, ok); ``ok`` is false where
    the URL is not among the stored pages.  Addresses are compared as they are.  Without `urls`
    the rows are the same but have no ``url``, for those who only count them.
    """
    network = _Network(link_graph(pages), seeds)
    visited = _Visited(pages.sparkSession, "page long, ok boolean")
    try:
        depth, size = 0, visited.add(network.starts, 0)
        while size and (max_depth is None or depth < max_depth):
            found = visited.level(depth).where("ok").select("seed", "page").join(network.links, "page").groupBy("seed", "url").agg(
                F.bool_or("ok").alias("ok"))
            depth += 1
            size = visited.add(visited.new(found).selectExpr("seed", "url", "url AS page", "ok"), depth)
        return network.named(visited.close(), "depth", "ok", urls=urls).drop("stored")
    finally:
        visited.drop()


def bounded_crawl(pages: DataFrame, seeds: DataFrame, max_pages: int = 100, max_depth: int = 5,
                  same_domain: bool = True, scores: DataFrame | None = None,
                  min_content_length: int = MIN_CONTENT_LENGTH, urls: bool = True) -> DataFrame:
    """Breadth-first crawl that stops after `max_pages` successes per seed.

    URLs are taken in queue order: by depth, then by the place of the page they were found
    on, then by their place in that page's queue.  ``place`` holds that order, so the cut at
    `max_pages` is the same however the work is spread.  Links lead to the stored page with
    the same canonical address.  Result: (seed, url, depth, place, ok, stored); ``stored`` is
    the page's own address.  A URL that is missing or too short is tried once and counts as
    failed.  Without `urls` the rows are the same but have neither ``url`` nor ``stored``, for those who only count them.
    """
    network = _Network(ranked_link_graph(pages, same_domain, scores, min_content_length), seeds, canonical("seed"))
    visited = _Visited(pages.sparkSession, "page long, place array<int>, ok boolean")
    budget = _Budget(max_pages)
    try:
        frontier = network.starts.selectExpr("seed", "url", "page", "cast(array() as array<int>) AS place", "ok")
        for depth in range(max_depth + 1):
            if not visited.add(frontier, depth):
                break
            level = visited.level(depth)
            budget.spend(level, depth)
            # Seeds with a full budget leave before their pages are expanded.
            taken = budget.unfinished(level.where("ok")).select("seed", "page", "place")
            found = taken.join(network.links, "page").groupBy("seed", "url").agg(
                F.min(F.expr("concat(place, array(n))")).alias("place"), F.bool_or("ok").alias("ok"))
            frontier = visited.new(found).selectExpr("seed", "url", "url AS page", "place", "ok")
        return network.named(budget.cut(visited.close()), "depth", "place", "ok", urls=urls)
    finally:
        visited.drop()


class _Budget:
    """Successes per seed, level by level, and where a seed's last level is cut.

    Only seeds that a level takes beyond their budget are looked at row by row: their
    successes are numbered by a range sort, so one start URL over a large site is many tasks.
    """

    def __init__(self, most: int):
        self.most, self.used, self.full, self.cuts = most, None, 0, []

    def spend(self, level: DataFrame, depth: int) -> None:
        """Count a level; the counts and whether any seed is beyond its budget come out of one job."""
        hits = level.groupBy("seed").agg(F.count_if("ok").alias("hits"), F.count_if(~F.col("ok")).alias("misses"))
        if self.used is None:
            now = hits.selectExpr("seed", "0L AS before", "hits AS used", "misses")
        else:
            now = self.used.selectExpr("seed", f"least(used, {self.most}L) AS before").join(hits, "seed", "full").selectExpr(
                "seed", "coalesce(before, 0L) AS before", "coalesce(before, 0L) + coalesce(hits, 0L) AS used",
                "coalesce(misses, 0L) AS misses")
        over = f"before < {self.most} and (used > {self.most} or used = {self.most} and misses > 0)"
        seen = Observation()
        counted = now.observe(seen, F.count_if(F.expr(over)).alias("over"), F.count_if(F.expr(f"used >= {self.most}")).alias("full"))
        self.used = written(counted, "used")
        self.full = seen.get["full"]
        if seen.get["over"]:
            beyond = self.used.where(over).select("seed", "before")
            numbered = number_within(level.where("ok").join(beyond, "seed").select("seed", "place", "before"), "seed", ["place"], "_n")
            self.cuts.append(numbered.where(F.col("_n") + F.col("before") + 1 == self.most).select(
                "seed", F.lit(depth).alias("depth"), F.col("place").alias("_last")))

    def unfinished(self, rows: DataFrame) -> DataFrame:
        """Rows of seeds that have budget left."""
        return rows if not self.full else rows.join(self.used.where(F.col("used") >= self.most).select("seed"), "seed", "left_anti")

    def cut(self, visited: DataFrame) -> DataFrame:
        """Without what lies behind the place at which a seed's budget was full."""
        if not self.cuts:
            return visited
        cuts = self.cuts[0]
        for more in self.cuts[1:]:
            cuts = cuts.unionAll(more)
        return visited.join(written(cuts, "cuts"), ["seed", "depth"], "left").where("_last is null or place <= _last").drop("_last")


def outcomes(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier URLs with ``ok``: is a page with that canonical address stored?  Only URLs are read."""
    stored = pages.selectExpr(f"{canonical('url')} AS _key").distinct().withColumn("_stored", F.lit(True))
    return frontier.selectExpr("*", f"{canonical('url')} AS _key").join(stored, "_key", "left").withColumn(
        "ok", F.col("_stored").isNotNull()).drop("_stored", "_key")


def crawl_records(visited: DataFrame, pages: DataFrame, annotations: DataFrame | None = None,
                  min_content_length: int = MIN_CONTENT_LENGTH) -> DataFrame:
    """What a bounded crawl returns: the record of every page it visited, with seed, depth and place.

    Model fields, when given by ``page_id``, replace the record's before short pages are dropped.
    """
    reached = visited.filter("ok").select("seed", F.col("url").alias("visited_url"), "depth", "place", F.col("stored").alias("url"))
    wanted = [c for c in ("page_id", "url", "html") if c in pages.columns]
    # Pages that no crawl reached are not parsed; of several versions the first counts, as in the crawl.
    near = pages.select(*wanted).join(reached.select("url").distinct(), "url", "left_semi")
    records = extract_pages(parse_pages(_first_page(near)))
    if annotations is not None:
        records = merge_annotations(records, annotations)
    records = written(records, "records").filter(F.length("main_content") >= min_content_length)
    return reached.join(records, "url").select("seed", "visited_url", "depth", "place", *records.columns)


def _first_page(pages: DataFrame) -> DataFrame:
    """One row per address: the version with the lowest id."""
    if "page_id" not in pages.columns:
        return pages.groupBy("url").agg(F.min("html").alias("html"))
    return pages.groupBy("url").agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("page_id")).select(*pages.columns)


def enqueue(queue: DataFrame, links: DataFrame, visited: DataFrame, key: list[str]) -> DataFrame:
    """The queue plus those links that are neither queued nor visited."""
    new = links.select(*key).distinct().join(visited, key, "left_anti").join(queue, key, "left_anti")
    return queue.select(*key).unionByName(new)


def domain_gate(frontier: DataFrame, base_url: str = "seed", url: str = "url") -> DataFrame:
    """Keep URLs whose authority is exactly that of the start URL."""
    return frontier.filter(f"{netloc(url)} = {netloc(base_url)}")

"""URL expressions against the standard library, and link tables on fixtures."""

import random
from urllib.parse import parse_qs, urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators import links as L


def canonical(url):
    parts = urlparse(url)
    if parts.scheme not in ("http", "https"):
        return None
    params = {k: v for k, v in parse_qs(parts.query, keep_blank_values=True).items()
              if k.lower() not in U.TRACKING_PARAMS}
    query = "&".join(f"{k}={v[0]}" for k, v in sorted(params.items()))
    path = parts.path or "/"
    return urlunparse((parts.scheme, parts.netloc.lower(), path if path == "/" else path.rstrip("/"),
                       parts.params, query, ""))


def test_random_urls_agree_with_the_standard_library(spark):
    rnd = random.Random(7)
    segments = ["a", "B", "..", ".", "", "x.html", "p;q", "%41%zz", "é", "a b", ";", "..;z", "c=d", "a:b"]
    params = ["a=1", "A=2", "b", "=", "utm_source=x", "UTM_Term=1", "c=%20+x", "ref=", "a=3", "", "é=%C3%A9",
              "x=%ff%zz", "k=a=b"]

    def url():
        path = "/".join(rnd.choice(segments) for _ in range(rnd.randint(0, 5)))
        query = "&".join(rnd.choice(params) for _ in range(rnd.randint(0, 4)))
        return (rnd.choice(["", "http:", "https:", "HTTP:", "mailto:", "ftp:", "file:", "javascript:", "1x:", " http:"])
                + rnd.choice(["", "//h.com", "//H.Com:80", "//u@H", "//", "//w\tx"]) + rnd.choice(["", "/"]) + path
                + rnd.choice(["", "?" + query]) + rnd.choice(["", "#f", "#a/../b?c"]))

    bases = ["http://ex.com/a/b;p/c.html?z=1#t", "https://EX.com", "http://ex.com/", "http://ex.com/x/y/?q",
             "http://ex.com/d//e/", "http://ex.com/a/./../b"]
    rows = []
    for _ in range(4000):
        base, href = rnd.choice(bases), url()
        rows.append((base, href, urljoin(base, href), canonical(href), urlparse(href).netloc))
    found = spark.createDataFrame(rows, "base string, href string, joined string, norm string, host string").selectExpr(
        "*", f"{U.resolve_url('base', 'href')} AS joined_2", f"{U.normalize_url('href')} AS norm_2",
        f"{U.netloc('href')} AS host_2")
    assert found.filter("not (joined <=> joined_2 and norm <=> norm_2 and host <=> host_2)").collect() == []



def test_plain_addresses_take_a_short_way_to_the_same_results(spark):
    """Plain links are resolved and normalised without being split; near misses and very long paths too."""
    rnd = random.Random(11)
    paths = ["", "/", "/a", "/a/b", "/a/b/", "/a//b", "/A-b_~/c", "/a.b/c", "/a/.", "/..", "/a/b;p", "//x/y"]
    queries = ["", "?", "?ref=o", "?REF=1", "?a=1", "?a=", "?=a", "?a", "?b=1&a=2", "?a=1=2", "?a=b.c~", "?utm_source=x&ref=y", "?a=%41", "?a=1#f", "#f"]
    hosts = ["http://h.com", "https://h.com:80", "http://H.com", "HTTP://h.com", "ftp://h.com", "http://u@h.com", "http://", "http://h.com\n"]
    leads = ["", "../", "../../", "./", "/", "//", "a", "../a", "a/", "?", "a:b/", "\u00e9"]
    rows = [(b + p, lead + t.lstrip("/") + q, b + p + q) for b in hosts for p in paths for lead in leads
            for t, q in [(rnd.choice(paths), rnd.choice(queries)) for _ in range(6)]]
    rows += [("http://h.com/x", "a/" * 20_000 + "z?ref=o", "http://h.com" + "/a" * 20_000 + "?ref=o")]
    found = spark.createDataFrame(
        [(b, h, u, urljoin(b, h), canonical(u)) for b, h, u in rows if "\n" not in b], "base string, href string, url string, joined string, norm string").selectExpr(
        "*", f"{U.resolve_url('base', 'href')} AS joined_2", f"{U.normalize_url('url')} AS norm_2")
    assert found.filter("not (joined <=> joined_2 and norm <=> norm_2)").limit(5).collect() == []
    assert "RLIKE(url#" in (plan := found.select("norm_2")._jdf.queryExecution().optimizedPlan().toString()) and "^https?://" in plan
    line = spark.createDataFrame([("http://h.com/a\n",)], "u string").selectExpr(f"{U.normalize_url('u')} AS n").first().n
    assert line == "http://h.com/a"


HTML = """<body><div class="topnav"><span><i><a href="/a?utm_source=1&b=2">x</a></i></span></div>
<a href="../q/./r#f" rel="nofollow me" title="T" target="_new"></a><a href="mailto:x">m</a>
<a href="HTTPS://Sub.Example.com/a.pdf">dl</a><a href="http://netflix.com/">n</a><a href="/a?b=2">dup</a>
<a href=" /login "> Home </a><a>no</a><a href="//www.example.com/p/">P  q</a><a href="/x.css">  next
</a><a href="http://other.org/About" aria-label="L"> </a><a href="/pic.JPG">i</a>
<div id="menu"><p><p><p><a href="/far">far</a></body>"""


def table(page, **settings):
    return L.extract_links(page(HTML, url="https://example.com/d/e/f"), **settings).orderBy("pos").collect()


def test_link_table(page):
    rows = {r.url: r for r in table(page)}
    assert list(rows) == [
        "https://example.com/a?b=2", "https://example.com/d/q/r", "https://sub.example.com/a.pdf",
        "http://netflix.com/", "https://example.com/login", "https://www.example.com/p",
        "https://example.com/x.css", "http://other.org/About", "https://example.com/pic.JPG",
        "https://example.com/far"]
    first = rows["https://example.com/a?b=2"]
    assert (first.text, first.is_internal, first.is_navigation, first.link_type) == ("x", True, True, "content")
    second = rows["https://example.com/d/q/r"]
    assert (second.text, second.title, second.rel, second.target, second.is_navigation) == (
        "T", "T", "nofollow", "_new", True)
    assert rows["https://sub.example.com/a.pdf"].link_type == "download"
    assert rows["https://sub.example.com/a.pdf"].is_resource and rows["https://sub.example.com/a.pdf"].is_internal
    assert rows["http://netflix.com/"].link_type == "social" and not rows["http://netflix.com/"].is_internal
    login = rows["https://example.com/login"]
    assert (login.text, login.is_navigation, login.link_type) == ("Home", True, "navigation")
    assert rows["https://www.example.com/p"].is_internal
    css = rows["https://example.com/x.css"]
    assert (css.text, css.is_navigation, css.is_resource, css.link_type) == ("next", True, True, "content")
    about = rows["http://other.org/About"]
    assert (about.text, about.link_type, about.is_internal) == ("L", "navigation", False)
    assert rows["https://example.com/pic.JPG"].link_type == "media"
    # four levels up is too far
    assert not rows["https://example.com/far"].is_navigation


def test_options(page):
    kept = [r.url for r in table(page, strip_tracking=False, include_fragments=True)]
    assert kept[:2] == ["https://example.com/a?utm_source=1&b=2", "https://example.com/d/q/r#f"]
    parsed = page(HTML, url="https://example.com/d/e/f").withColumn("start", F.lit("http://other.org/"))
    inside = L.internal(L.extract_links(parsed, base_url_col="start")).collect()
    assert [r.url for r in inside] == ["http://other.org/About"]


def test_filters(page):
    links = L.extract_links(page(HTML, url="https://example.com/d/e/f"))
    assert {r.url for r in L.external(links).collect()} == {"http://netflix.com/", "http://other.org/About"}
    assert {r.url for r in L.content_links(links).collect()} == {
        "https://www.example.com/p", "https://example.com/far"}
    assert L.public_columns(links).columns[3:] == L.PUBLIC_COLUMNS


def test_unreadable_link_empties_the_page(page):
    assert L.extract_links(page('<a href="/a">a</a><a href="http://[x">b</a>')).count() == 0


def test_many_duplicate_links_stay_linear(page):
    html = "".join(f'<a href="/p{i % 700}">{i}</a>' for i in range(7000))
    rows = L.extract_links(page(html)).orderBy("pos").collect()
    assert [r.text for r in rows] == [str(i) for i in range(700)]


def test_same_domain_links_are_raw(page):
    rows = L.same_domain_links(page(HTML, url="https://example.com/d/e/f")).collect()
    assert {r.url for r in rows} == {
        "https://example.com/a?utm_source=1&b=2", "https://example.com/d/q/r#f", "https://example.com/a?b=2",
        "https://example.com/login ", "https://example.com/x.css", "https://example.com/pic.JPG",
        "https://example.com/far"}


def test_hostname_links(page):
    parsed = page('<a href="//Example.com:8080">a <b>b</b></a><a href="#t">t</a><a href="http://x.org">o</a>',
                  url="https://example.com/p")
    own = L.hostname_links(parsed).orderBy("pos").collect()
    assert [(r.href, r.text) for r in own] == [("https://example.com:8080/", "a b"), ("https://example.com/p#t", "t")]
    assert L.hostname_links(parsed, same_domain=False).count() == 3


def test_unique_urls_and_followable(page, spark):
    links = L.extract_links(page('<a href="/a">1</a><a href="/b">2</a>', '<a href="/a">3</a>'))
    rows = {r.url: r.page_id for r in L.unique_urls(links).collect()}
    assert rows == {"https://example.com/a": 1, "https://example.com/b": 1}
    visited = spark.createDataFrame([("https://example.com/a",)], "url string")
    assert [r.url for r in L.followable(links, visited).collect()] == ["https://example.com/b"]

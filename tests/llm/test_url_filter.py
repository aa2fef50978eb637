import math
from collections import Counter

import pytest

from pagewright.llm import url_filter as U


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")


def test_host_path_and_rule(spark):
    urls = [
        "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "http://org/", "http://x.com/fr/1", "http://com/de/",
        "http://example.com", "http://example.org", "ftp://u@Ünï.ORG:80/a b", "no scheme", None, "", "http://xorg/", "http://a.org?x/es/",
    ]
    rows = U.judge(pages(spark, urls)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in rows] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("org", "/", "org/"),
        ("x.com", "/fr/1", "com/fr/"), ("com", "/de/", "com/de/"), ("example.com", "", None), ("example.org", "", None),
        ("u@Ünï.org:80", "/a b", None), ("", "", None), ("", "", None), ("", "", None), ("xorg", "/", None), ("a.org", "", None)]
    assert [r.verdict for r in rows[:5]] == ["block", "block", "allow", "allow", "block"]
    assert all(r.verdict in ("allow", "block") for r in rows)


def brute_ratios(accepted, rejected):
    """Log ratio of a character after two, straight from the definition."""
    symbols = {c: i + 1 for i, c in enumerate(U.ALPHABET)}

    def codes(url):
        return [symbols.get(c, len(U.ALPHABET) + 1) for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)]

    def model(urls):
        counts = [Counter(), Counter(), Counter()]
        for url in urls:
            p = [0, 0, *codes(url)]
            for i in range(2, len(p)):
                for k in range(3):
                    counts[k][tuple(p[i - k: i + 1])] += 1

        def chance(gram):
            p = 1 / U.SYMBOLS
            for k in range(3):
                context = gram[2 - k: 2]
                after = [n for g, n in counts[k].items() if g[:-1] == context]
                if after:
                    p = (counts[k][gram[2 - k:]] + len(after) * p) / (sum(after) + len(after))
            return p
        return chance

    yes, no = model(accepted), model(rejected)

    def difference(url):
        p = [0, 0, *codes(url)]
        grams = [tuple(p[i - 2: i + 1]) for i in range(2, len(p))]
        return sum(math.log(yes(g)) - math.log(no(g)) for g in grams) / len(grams) if grams else 0.0
    return difference


def test_differences_equal_brute_force(spark):
    urls = [f"http://site{i % 5}.com/{'fr' if i % 3 else 'de'}/p{i}" for i in range(40)] + ["http://other.net/q", "x☃y", ""]
    frame = pages(spark, urls)
    folds = {r.url: r.f for r in frame.selectExpr("url", f"{U.fold()} AS f").collect()}
    train = [u for u in urls[:40] if folds[u] > 0]
    difference = brute_ratios([u for u in train if "/fr/" in u], [u for u in train if "/de/" in u])
    for r in U.judge(frame).collect():
        assert r.difference == pytest.approx(difference(urls[r.page_id]), abs=1e-9)
        if r.rule is None:
            assert r.verdict == ("allow" if r.difference >= r.threshold else "block")


def test_threshold_separates_what_the_models_did_not_see(spark):
    urls = [f"http://s{i}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(200)]
    rows = U.judge(pages(spark, urls)).collect()
    assert sum((r.difference >= r.threshold) == (r.verdict == "allow") for r in rows) >= 190


def test_no_evidence_and_long_urls(spark):
    assert U.judge(pages(spark, [])).collect() == []
    rows = U.judge(pages(spark, ["http://a.net/" + "x/" * 20_000, "http://a.net/"])).collect()
    assert [r.verdict for r in rows] == ["allow", "allow"]

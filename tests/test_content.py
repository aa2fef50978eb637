"""Page records on fixtures with features the given tables lack."""

import pytest

from pagewright.functions import nodes as N
from pagewright.operators import content as C
from pagewright.sources.parse import ELEMENT

FULL = """<!DOCTYPE html><html lang="de"><head><title> Main  Title </title>
<meta name="description" content=" About it "><meta name="keywords" content="a, b,, c ">
<meta name="author" content=" Ann "><meta property="article:published_time" content="2024-01-02">
<meta property="article:modified_time" content="2024-02-03"></head><body>
<header><nav><a href="/">Home</a></nav></header>
<main><h1>One <i>two</i></h1><h2>Second</h2><h1>Again</h1><h2> </h2>
<p>This paragraph has enough text.</p><p>Short.</p>
<ul><li>first</li><li> </li><li>third<ul><li>inner</li></ul></li></ul><ol></ol>
<a href="/in">in</a><a href="x?y=1#z">rel</a><a href="https://other.org/p">out</a><a href="/in">again</a>
<a href="JavaScript:void(0)">odd</a><a href="mailto:a@b">m</a><a href="#top">t</a><a>none</a>
<img src="a.png" alt="A" title="T"><img data-src="lazy.png"><img src="" data-src="b.png"><img alt="no">
</main><footer>foot</footer></body></html>"""


def extract(parsed, **settings):
    return C.extract_pages(parsed, **settings).orderBy("page_id").collect()


def test_full_page(page):
    row = extract(page(FULL))[0]
    assert row.title == "Main  Title"
    assert row.meta_description == "About it"
    assert row.meta_keywords == ["a", "b", "c"]
    assert row.language == "de"
    assert (row.author, row.date_published, row.date_modified) == ("Ann", "2024-01-02", "2024-02-03")
    assert [(h.level, h.text) for h in row.headings] == [("h1", "Onetwo"), ("h1", "Again"), ("h2", "Second")]
    assert row.paragraphs == ["This paragraph has enough text."]
    assert row.lists == [["first", "thirdinner"], ["inner"]]
    assert [(i.src, i.alt, i.title) for i in row.images] == [
        ("a.png", "A", "T"), ("lazy.png", "", ""), ("b.png", "", "")]
    assert row.internal_links == [
        "https://example.com/in", "https://example.com/dir/x?y=1#z", "JavaScript:void(0)"]
    assert row.external_links == ["https://other.org/p"]
    assert row.main_content.startswith("One two Second Again This paragraph")
    assert "Home" not in row.text and "foot" not in row.text and row.text.startswith("Main Title One two")
    assert row.extraction_success and row.error is None


def test_noise_can_stay_and_images_can_be_left_out(page):
    row = extract(page(FULL), remove_noise=False, extract_images=False)[0]
    assert row.images == [] and "Home" in row.text and "https://example.com/" in row.internal_links


def test_nothing_to_find(page):
    row = extract(page("plain words"))[0]
    assert (row.title, row.meta_description, row.language, row.main_content) == ("", "", "", "")
    assert row.text == "plain words"
    assert (row.author, row.date_published, row.date_modified) == (None, None, None)
    assert row.meta_keywords == [] and row.headings == [] and row.lists == []


@pytest.mark.parametrize("html, expected", [
    ('<meta property="og:title" content=" OG "><h1>H</h1>', "OG"),
    ('<title></title><meta property="og:title" content=""><h1>H <b>x</b></h1>', "Hx"),
    ("<title><b>a</b></title>", "a"),
    ("<title>a<b>b</b></title><h1>H</h1>", "H"),
    ("<svg><title>in svg</title></svg>", "in svg"),
])
def test_title_choices(page, html, expected):
    assert extract(page(html))[0].title == expected


@pytest.mark.parametrize("html, expected", [
    ('<span itemprop="author"> B <i>C</i></span>', "BC"),
    ('<a rel="nofollow author" href="x">D</a>', "D"),
    ('<meta name="author" content=""><a rel="author">E</a>', "E"),
    ('<a rel="authors">E</a>', None),
    ('<script itemprop="author">js</script>', "js"),
])
def test_author_choices(page, html, expected):
    assert extract(page(html))[0].author == expected


@pytest.mark.parametrize("html, published, modified", [
    ('<time datetime="2020">x</time>', "2020", None),
    ('<b itemprop="datePublished">d1</b><time datetime="2020"></time>', "d1", None),
    ('<b itemprop="datePublished" content="c">d1</b>', "c", None),
    ('<meta property="pubdate" content="p"><i itemprop="dateModified"> m </i>', "p", "m"),
    ('<meta property="datePublished" content="q"><i itemprop="article:published_time">first</i>', "first", None),
])
def test_dates(page, html, published, modified):
    row = extract(page(html))[0]
    assert (row.date_published, row.date_modified) == (published, modified)


def test_description_and_language_fallbacks(page):
    rows = extract(page(
        '<meta name="description" content=""><meta property="og:description" content=" og ">',
        '<html lang=""><meta http-equiv="content-language" content="fr">'))
    assert rows[0].meta_description == "og" and rows[1].language == "fr"


def test_noise_is_matched_by_substring(page):
    html = ('<div class="shadow">a</div><div id="Reader">b</div><div class="x  SideBar">c</div><p>d</p>'
            '<div class="keep"><form>e<p class="menu">f</p></form>g</div><span>h</span>')
    # "ad" is in shadow and Reader; "sidebar", "menu" are indicators; form is a noise tag
    assert extract(page(html))[0].text == "d g h"


def test_nested_noise_is_dropped_once(page):
    html = "<p>1</p><nav>a<div class='ad'>b<nav>c</nav></div></nav><p>2</p><aside><aside>x</aside>y</aside><p>3</p>"
    assert extract(page(html))[0].text == "1 2 3"


def test_main_content_prefers_article_then_main(page):
    long_div = "<div class='content'>" + "word " * 100 + "</div>"
    rows = extract(page(long_div + "<main>M</main><article>A</article>", long_div + "<main>M</main>"))
    assert [r.main_content for r in rows] == ["A", "M"]


def test_scoring_picks_the_best_element(page):
    html = ("<body><div>" + "x" * 90 + "</div><section class='story'><p>one</p><p>two</p></section>"
            "<div class='post text'>tiny</div></body>")
    # div: 0.9; section: 10 + 4 + 0.06; post text: 20 + 0.04
    assert extract(page(html))[0].main_content == "tiny"


def test_scoring_ties_keep_the_first_and_need_a_positive_score(page):
    rows = extract(page(
        "<section>aa</section><div>bb</div><div>cc</div>",
        "<body><div></div>rest</body>"))
    assert [r.main_content for r in rows] == ["bb", "rest"]


def test_raw_text_length_counts_for_the_score(page):
    html = "<section><p>x</p></section><div>" + " \n" + "y" * 300 + "</div><div><p>a</p><p>b</p></div>"
    # section: 2.01, first div: 0.01 * 302 = 3.02, second div: 4.02
    assert extract(page(html))[0].main_content == "a b"


def test_content_is_cut(page):
    row = extract(page("<article>" + "é" * 50 + "</article>"), max_content_length=20)[0]
    assert row.main_content == "é" * 20 and row.text == "é" * 20


def test_unreadable_link_fails_the_page_but_keeps_the_row(page):
    rows = extract(page('<title>t</title><a href="http://[x/">l</a>', "<title>u</title>"))
    assert (rows[0].extraction_success, rows[0].error, rows[0].title) == (False, "Invalid IPv6 URL", "")
    assert rows[1].title == "u"
    noisy = extract(page('<title>t</title><nav><a href="http://[x/">l</a></nav>'))[0]
    assert noisy.extraction_success


def test_basic_record(page):
    rows = C.basic_record(page(
        "<title> T </title><meta name='description' content=' d '><script>s</script><p> a </p>b",
        "<title></title>", "<meta name='description'>")).orderBy("page_id").collect()
    assert [(r.title, r.text, r.meta_description) for r in rows] == [
        (" T ", "T a b", " d "), (None, None, None), (None, None, None)]


def test_text_only_falls_back_to_tag_stripping(spark):
    parsed = spark.createDataFrame(
        [(1, "<p>a</p>", [], [], "broken"), (2, "x", [], [], None)],
        f"page_id long, html string, elements array<{ELEMENT.simpleString()}>, texts array<struct<box:string,raw:string>>, "
        "parse_error string")
    rows = C.text_only(parsed.replace("<p>a</p>", "<p>a &amp;\t b</p><i>&eacute;</i>")).orderBy("page_id").collect()
    assert [r.text for r in rows] == ["a & b é", ""]


def test_page_record_counts(page):
    row = C.page_record(C.extract_pages(page(FULL))).collect()[0]
    assert (row.internal_links_count, row.external_links_count, row.images_count) == (3, 1, 3)


def test_min_content_and_results(page):
    records = C.extract_pages(page("<article>" + "w" * 100 + "</article>", "<article>short</article>", "text"))
    assert [r.page_id for r in C.min_content(records).collect()] == [1]
    rows = C.to_results(records).orderBy("page_id").collect()
    assert [r.content[:5] for r in rows] == ["wwwww", "short", "text"]
    assert rows[0].content_type == "unknown" and rows[0].headings == {} and rows[0].status_code == 200


def test_scores_of_clean_parts_against_counting_by_hand(page):
    """Totals less those of noise: what is left inside each candidate, element by element."""
    import random

    draw = random.Random(3)
    for _ in range(6):
        html, open_tags = [], []
        for _ in range(120):
            if open_tags and draw.random() < 0.4:
                html.append(f"</{open_tags.pop()}>")
            else:
                tag = draw.choice(["div", "div", "p", "section", "nav", "span", "aside", "script"])
                html.append(f"<{tag}{draw.choice(['', '', ' class=menu'])}>{'t' * draw.randint(0, 30) if draw.random() < 0.6 else ''}")
                if tag == "script":
                    html.append("</script>")
                else:
                    open_tags.append(tag)
        clean = C.with_clean_tree(page("".join(html)))
        row = clean.selectExpr(
            "elements", "_elements", "_texts", f"{N.noise_totals('_elements', '_noise')} AS gone").first()
        assert len(row.gone) == len(row.elements)
        for e in row._elements:
            if e is None:
                continue
            inside = [x for x in row._elements[e.pos: e.last] if x is not None and x.tag == "p"]
            chars = sum(len(t.raw) for t in row._texts[e.text_from - 1: e.text_to - 1] if t.box == "")
            start, end = row.gone[e.pos - 1], row.gone[e.last - 1]
            assert e.paragraphs - (end.paragraphs - start.paragraphs) == len(inside)
            assert e.chars - (end.chars - start.chars) == chars


def test_deep_nesting_is_scored_in_seconds(page):
    import time

    deep = "<div>" * 100_000 + "<p>some words</p>" + "</div>" * 100_000
    start = time.perf_counter()
    row = C.extract_pages(page(deep)).select("main_content").first()
    assert row.main_content == "some words"
    assert time.perf_counter() - start < 60

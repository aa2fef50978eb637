"""The parse job: tree shape, strings, entities, broken markup."""

import random
from html.parser import HTMLParser

import pyarrow as pa

from pagewright.sources import parse as P


def read(html, reader=P._PageReader):
    out = P._Columns()
    reader(out).read(html)
    out.close_page(None)
    return out


def tree(html):
    out = read(html)
    return list(zip(out.tag, out.pos, out.last, out.parent))


def texts(html):
    out = read(html)
    return list(zip(out.box, out.raw))


def test_no_implied_end_tags():
    assert tree("<p>a<p>b</p>c") == [("p", 1, 2, 0), ("p", 2, 2, 1)]


def test_end_tag_closes_to_nearest_open_element():
    assert tree("<div><b><i>x</div><u>y</u>") == [
        ("div", 1, 3, 0), ("b", 2, 3, 1), ("i", 3, 3, 2), ("u", 4, 4, 0)]


def test_unknown_end_tag_is_ignored():
    assert tree("<p>a</b>b</p>") == [("p", 1, 1, 0)]


def test_void_elements_hold_nothing():
    assert tree("<p>a<br>b<img src=x>c</p>") == [("p", 1, 3, 0), ("br", 2, 2, 1), ("img", 3, 3, 1)]


def test_end_tag_of_void_element_closes_nothing():
    assert tree("<br></br><p>x</p>") == [("br", 1, 1, 0), ("p", 2, 2, 0)]


def test_self_closed_element_is_closed():
    assert tree("<div/><p>x</p>") == [("div", 1, 1, 0), ("p", 2, 2, 0)]


def test_entities_merge_into_one_string():
    assert texts("<p>a &amp; b &copy; &#65;&#x42; &nope; c</p>") == [("", "a & b © AB &nope c")]


def test_windows_character_references():
    assert texts("&#150;&#8211;") == [("", "––")]


def test_strings_outside_text_are_boxed():
    assert texts("<script>var a='<p>';</script><!-- c --><style>x</style>t<template><b>u</b></template>") == [
        ("script", "var a='<p>';"), ("comment", " c "), ("style", "x"), ("", "t"), ("template", "u")]


def test_blank_strings_shrink_except_in_pre():
    assert texts("<p> \n </p><p>   </p><pre>  \n </pre>") == [("", "\n"), ("", " "), ("", "  \n ")]


def test_last_of_repeated_attributes_wins():
    out = read('<a href="1" HREF="2" disabled>')
    assert dict(zip(out.attr_key, out.attr_value)) == {"href": "2", "disabled": ""}


def test_cdata_section_is_text():
    assert ("", "x") in texts("<p><![CDATA[x]]></p>") or texts("<p><![CDATA[x]]></p>")[0][0] == "comment"


class Tolerant(P._PageReader):
    """Without the shortcut for plain markup."""

    goahead = HTMLParser.goahead


def test_shortcut_for_plain_markup_changes_nothing():
    rnd = random.Random(11)
    pieces = [
        "<p>", "</p>", '<DIV class="a b">', "</div>", "<br>", "</br>", "<br/>", '<a href="x&amp;y">', "</a >",
        "<script>", "</script>", "if(a<b){}", "</SCRIPT >", "</p", "<p", "<!-- c -->", "<!doctype html>", "&amp;",
        "&lt", "&foo;", "&#65;", "text", " ", "\n ", "<img src=x>", "<title>", "</title>", "<style>", "</style>",
        "<pre>", "</pre>", "<template>", "</template>", "<b", ">", '"', "<?pi x>", "<1>", "&", "<", '<q a="1"b="2">',
    ]

    def all_columns(reader, html):
        out = P._Columns()
        reader(out).read(html)
        return vars(out)

    for _ in range(3000):
        html = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25)))
        assert all_columns(P._PageReader, html) == all_columns(Tolerant, html), html


def test_missing_html_keeps_its_row(page):
    rows = page("<p>a</p>", None).orderBy("page_id").collect()
    assert [r.parse_error for r in rows] == [None, "page has no html"]
    assert rows[1].elements == [] and rows[1].texts == []


def test_many_pages_in_one_batch(spark):
    html = "<div>" + "<p>word</p>" * 500 + "</div>"
    pages = spark.range(0, 900, 1, 1).selectExpr("id AS page_id", f"'{html}' AS html")
    counts = P.parse_pages(pages).selectExpr("page_id", "size(elements) AS n", "size(texts) AS t").distinct().collect()
    assert len(counts) == 900 and {(r.n, r.t) for r in counts} == {(501, 500)}


def test_broken_page_between_sound_ones(page):
    from pagewright.operators.content import extract_pages, text_only

    parsed = page("<title>a</title>", "<title>b</title><p>x &amp; y</p><![foo]>", "<title>c</title>", keep_html=True)
    rows = extract_pages(parsed).orderBy("page_id").collect()
    assert [(r.title, r.extraction_success) for r in rows] == [("a", True), ("", False), ("c", True)]
    assert "foo" in rows[1].error or rows[1].error
    assert rows[1].html.startswith("<title>b")
    assert [r.text for r in text_only(parsed).orderBy("page_id").collect()] == ["a", "b x & y", "c"]


def test_output_batches_stay_small():
    html = "<p>some words</p>" * 1000
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(60)) + [60], "html": [html] * 60 + [None]})
    found = list(P._parse_batches("html", ["page_id"], ["page_id", "elements", "texts", "parse_error"])(iter([batch])))
    assert [i for b in found for i in b.column("page_id").to_pylist()] == list(range(61))
    assert max(sum(map(len, b.column("elements").to_pylist())) for b in found) <= 20_000
    assert all(len(e) == 1000 for b in found for e in b.column("elements").to_pylist()[:-1])
    assert found[-1].column("parse_error").to_pylist()[-1] == "page has no html"

"""Prompts, model answers, merges."""

import json

import pandas as pd

from pagewright.operators import annotate as M


def answers(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "page_id long, body string")


GOOD = {"title": "T", "main_content": "M", "summary": "S", "headings": ["a", "b"], "author": None,
        "topics": ["x"], "confidence_score": 0.75, "content_type": "article"}


def test_content_responses(spark):
    text = json.dumps(GOOD)
    rows = M.parse_content_responses(answers(
        spark, text, f"Sure!\n```json\n{text}\n```", f"It is {text} ok", "nothing here", "{broken", "[1, 2]",
        '{"confidence_score": "0.5"}', '{"confidence_score": "high"}', '{"title": null}', None,
        "```json\n{bad}\n``` {\"title\": \"later\"}")).orderBy("page_id").collect()
    for r in rows[:3]:
        assert (r.title, r.main_content, r.summary, r.headings, r.author, r.topics, r.confidence_score) == (
            "T", "M", "S", ["a", "b"], None, ["x"], 0.75)
    for r in (rows[3], rows[4], rows[5], rows[7], rows[9], rows[10]):
        assert (r.title, r.confidence_score, r.content_type) == ("", 0.0, "article")
        assert r.summary.startswith("Error: ")
    assert (rows[6].confidence_score, rows[6].content_type, rows[6].title) == (0.5, "unknown", "")
    assert rows[8].title is None


def test_strict_content_responses(spark):
    rows = M.parse_content_responses(answers(spark, json.dumps(GOOD), f"x {json.dumps(GOOD)}"), strict=True).orderBy(
        "page_id").collect()
    assert rows[0].title == "T"
    assert (rows[1].summary, rows[1].title) == ("", "") and rows[1].extraction_notes.startswith("Extraction failed")


def test_link_scores(spark):
    body = json.dumps({"links": [
        {"url": "/a", "relevance_score": 0.2}, {"url": "/b", "relevance_score": "0.9", "priority": 1,
                                                 "link_type": "news", "should_follow": False, "reasoning": "r"}, {}]})
    found = M.parse_link_scores(answers(spark, f"ok: {body}", '{"links": [{"relevance_score": "no"}]}', "none"))
    rows = found.orderBy("page_id", "place").collect()
    assert [(r.url, r.relevance_score, r.priority, r.link_type, r.should_follow) for r in rows] == [
        ("/a", 0.2, 5, "unknown", True), ("/b", 0.9, 1, "news", False), ("", 0.0, 5, "unknown", True)]
    strict = M.parse_link_scores(answers(spark, body, f"ok: {body}"), strict=True).orderBy("place").collect()
    assert [(r.page_id, r.should_follow) for r in strict] == [(0, False), (0, False), (0, False)]


def test_prompts(spark):
    pages = spark.createDataFrame([("http://u", "x" * 30)], "url string, html string")
    plain = M.content_prompts(pages).collect()[0].prompt
    assert "URL: http://u\n\nYour task:" in plain and plain.endswith("PAGE CONTENT:\n" + "x" * 30)
    goal = M.content_prompts(pages, goal="find", max_length=110).collect()[0].prompt
    assert "URL: http://u\nSpecific goal: find\n" in goal
    from pagewright.sources.parse import parse_pages
    anchors = "".join(f'<a href="http://h/l{i}">{"t" * 120}</a>' for i in range(60))
    links = parse_pages(spark.createDataFrame([(1, "http://h/", f"<body>{anchors}", "Ti"), (2, "http://h/2", "<p>x", "none")],
                                              "page_id long, url string, html string, title string"))
    whole = M.link_prompts(links, top=None).collect()
    assert len(whole) == 1 and whole[0].prompt.count("t" * 120) == 60
    prompt = M.link_prompts(links, goal="g", context=M.page_context("title", "'s'"), max_text=100).collect()[0].prompt
    lines = prompt.split("LINKS TO ANALYZE:\n")[1].split("\n")
    assert lines[0] == "- http://h/l0: " + "t" * 100 and len(lines) == 50
    assert "context: Title: Ti\nSummary: s\nCrawl goal: g\n" in prompt
    wide = M.link_prompts(links, top=30, compact=False, max_text=80).collect()[0].prompt.split("LINKS TO ANALYZE:\n\n\n")[1]
    assert wide.split("\n")[29] == "- URL: http://h/l29 | Text: " + "t" * 80 and wide.count("\n") == 29


def test_merges(spark):
    links = spark.createDataFrame([("p", 1, "/a", "content", True), ("p", 2, "/b", "content", True)],
                                  "page_url string, pos int, url string, link_type string, follow boolean")
    scores = spark.createDataFrame([("p", "/a", 0, 0.1, "x", True), ("p", "/a", 1, 0.7, "news", False)],
                                   "page_url string, url string, place int, relevance_score double, link_type string, "
                                   "should_follow boolean")
    rows = M.merge_scores(links, scores).orderBy("pos").collect()
    assert [(r.link_type, r.follow, r.relevance_score) for r in rows] == [("news", False, 0.7), ("content", True, 0.5)]
    records = spark.createDataFrame([(1, "t", "m", None, "d"), (2, "t2", "m2", "a", None)],
                                    "page_id long, title string, main_content string, author string, date_published string")
    notes = spark.createDataFrame([(1, "", "new", "who", None, "s", "article")],
                                  "page_id long, title string, main_content string, author string, "
                                  "date_published string, summary string, content_type string")
    merged = M.merge_annotations(records, notes).orderBy("page_id").collect()
    assert (merged[0].title, merged[0].main_content, merged[0].author, merged[0].date_published, merged[0].summary) == (
        "t", "new", "who", "d", "s")
    assert (merged[1].main_content, merged[1].summary, merged[1].content_type) == ("m2", "", "unknown")


def test_summaries_and_fallback_scores(spark):
    rows = spark.createDataFrame([(1, "long text here", None), (2, "x", "answer")], "page_id long, t string, a string")
    assert [r.summary for r in M.with_summaries(rows, "t", "a", 4).orderBy("page_id").collect()] == ["long...", "answ"]
    assert [r.summary for r in M.with_summaries(rows, "t", "a", 4, "empty").orderBy("page_id").collect()] == ["", "answ"]
    links = spark.createDataFrame([(1, "p", i, f"/{i}", "t") for i in range(40)],
                                  "page_id long, page_url string, pos int, url string, text string")
    assert M.fallback_scores(links).count() == 40


def test_annotate_runs_a_callers_function(spark):
    def upper(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(summary=batch["t"].str.upper())

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "page_id long, t string")
    found = M.annotate(rows, upper, "page_id long, t string, summary string").orderBy("page_id").collect()
    assert [r.summary for r in found] == ["A", "B"]


def test_merges_with_several_answers_keep_one_row(spark):
    links = spark.createDataFrame([("p", 1, "/a", "content", True)], "page_url string, pos int, url string, link_type string, follow boolean")
    scores = spark.createDataFrame([("p", "/a", 0.1, "x", True), ("p", "/a", 0.7, "news", False), ("p", "/a", 0.7, "news", True)],
                                   "page_url string, url string, relevance_score double, link_type string, should_follow boolean")
    row, = M.merge_scores(links, scores).collect()
    assert (row.link_type, row.follow, row.relevance_score) == ("news", True, 0.7)
    records = spark.createDataFrame([(1, "t", "m", None, "d")], "page_id long, title string, main_content string, author string, date_published string")
    notes = spark.createDataFrame([(1, "", "a", "w", None, "s", ""), (1, "new", "b", "", None, "", "article")],
                                  "page_id long, title string, main_content string, author string, date_published string, summary string, content_type string")
    row, = M.merge_annotations(records, notes).collect()
    assert (row.title, row.main_content, row.author, row.summary, row.content_type) == ("new", "b", "w", "s", "article")

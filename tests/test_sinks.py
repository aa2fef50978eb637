"""Export rows, written exports, format names, streams."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import stats as A
from pagewright.sinks import rows as R
from pagewright.sinks import save as S
from pagewright.streaming import pages as T

SCHEMA = ("url string, title string, content string, meta_description string, headings map<string,array<string>>, "
          "links array<map<string,string>>, images array<map<string,string>>, summary string, topics array<string>, "
          "content_type string, scraped_at string, load_time_ms double, status_code int, raw_html string")
FULL = ("http://u/1", "Title: Ä & co", 'He said "hi", twice\nnew line', "desc", {"h2": ["s"], "h1": list("abcdef")},
        [{"url": f"/l{i}", "text": "t" * 60 if i else ""} for i in range(12)], [{"url": "i.png", "alt": "x"}],
        "Sum", ["x", "y"], "article", "2024", 12.5, 200, "<p>")
BARE = ("http://u/2", "", "", None, {}, [], [], "", [], "unknown", "", 0.0, 404, None)


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([FULL, BARE], SCHEMA)


@pytest.fixture(scope="module")
def stats(spark):
    return A.complete_stats(spark.createDataFrame(
        [(3, 2, 1, "http://s", "s", 75.0)],
        "total_pages long, successful_pages long, failed_pages long, start_url string, domain string, duration_seconds double"))


def read_text(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_csv_cells(results):
    cells = R.csv_row(results, ["url", "topics", "links", "headings", "meta_description", "load_time_ms", "nope"]).orderBy(
        "url").collect()
    first = cells[0].asDict()
    # a map column does not keep the order in which a local dict was written
    assert sorted(first.pop("headings").split("; ")) == ["h1: ['a', 'b', 'c', 'd', 'e', 'f']", "h2: ['s']"]
    assert tuple(first.values()) == ("http://u/1", "x; y", "/l0; /l1; /l2; /l3; /l4", "desc", "12.5", "")
    assert tuple(cells[1]) == ("http://u/2", "", "", "", "", "0.0", "")


@pytest.mark.parametrize("name, separator", [("csv", ","), ("TSV", "\t")])
def test_delimited_files(results, tmp_path, name, separator):
    path = S.save(results, str(tmp_path / "out"), name)
    assert path.endswith("." + name.lower())
    rows = [r for f in sorted(glob.glob(f"{path}/part-*")) for r in csv.reader(
        open(f, newline="", encoding="utf-8"), delimiter=separator)]
    data = {r[0]: r for r in rows if r != R.CSV_COLUMNS}
    assert data["http://u/1"][3] == FULL[2] and data["http://u/2"] == [
        "http://u/2", "", "", "", "", "unknown", "", "404", "0.0", ""]
    assert R.CSV_COLUMNS in rows
    assert all(line.startswith('"') for line in read_text(path).splitlines() if line[:3] == '"ht')


def test_csv_with_statistics(results, stats, tmp_path):
    path = S.save(results, str(tmp_path / "with.csv"), stats=stats)
    lines = read_text(f"{path}/stats").splitlines()
    assert lines[0] == "# Statistics" and "# success_rate,66.7%" in lines and "# duration_formatted,1.2 minutes" in lines
    assert "# llm_provider,None" in lines


def test_flat_csv(results, spark, tmp_path):
    flat = R.flatten(results).orderBy("url")
    assert flat.columns == sorted(flat.columns)
    first, second = (r.asDict() for r in flat.collect())
    assert (first["headings_h1"], first["links_count"], first["links"], first["images_count"]) == (
        "a; b; c; d; e; f", "12", "", "1")
    assert (second["headings_h1"], second["links_count"], second["meta_description"], second["raw_html"]) == (
        "", "", "None", "")
    path = S.save(results.filter("false"), str(tmp_path / "none.csv"), "csv-flat")
    assert read_text(path) == ""


def test_json_document(results, stats, tmp_path):
    path = S.save(results, str(tmp_path / "doc"), "json", stats=stats)
    rows = {r["url"]: r for r in map(json.loads, read_text(f"{path}/data").splitlines())}
    assert "images" not in rows["http://u/1"] and "raw_html" not in rows["http://u/1"]
    assert rows["http://u/2"]["meta_description"] is None and rows["http://u/1"]["title"] == FULL[1]
    meta = json.loads(read_text(f"{path}/metadata"))
    assert (meta["format"], meta["version"], meta["total_results"]) == ("json", "1.0", 2)
    assert json.loads(read_text(f"{path}/stats"))["success_rate"] == "66.7%"


def read_document(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/*/part-*")))


def test_json_is_one_document(results, stats, spark, tmp_path):
    many = results.unionByName(results.limit(0)).repartition(7)  # some tasks have no rows
    path = S.save(many, str(tmp_path / "one"), "json", stats=stats, options=S.ExportOptions(document=True))
    found = json.loads(read_document(path))
    assert list(found) == ["metadata", "stats", "data"]
    assert (found["metadata"]["total_results"], found["stats"]["success_rate"]) == (2, "66.7%")
    assert sorted(r["url"] for r in found["data"]) == ["http://u/1", "http://u/2"]
    by_lines = spark.read.schema("url string, title string").option("mode", "DROPMALFORMED").json([f"{path}/2-first", f"{path}/3-data"])
    assert sorted(r.url for r in by_lines.collect()) == ["http://u/1", "http://u/2"]
    plain = S.ExportOptions(document=True, include_metadata=False, pretty_print=True)
    path = S.save(results, str(tmp_path / "plain"), "json", options=plain)
    assert list(json.loads(read_document(path))) == ["data"] and len(json.loads(read_document(path))["data"]) == 2
    path = S.save(results.filter("false"), str(tmp_path / "none"), "json", options=plain)
    assert json.loads(read_document(path)) == {"data": []}
    with pytest.raises(ValueError):
        S.save(results, str(tmp_path / "two"), "json", stats=stats.unionByName(stats), options=S.ExportOptions(document=True))


def test_an_export_that_fails_leaves_the_last_one(results, spark, tmp_path):
    target = str(tmp_path / "kept.jsonl")
    S.save(results, target)
    before = read_text(target)
    broken = results.withColumn("title", F.expr("if(url like '%1', raise_error('no'), title)"))
    with pytest.raises(Exception, match="no"):
        S.save(broken, target)
    assert read_text(target) == before and [p.name for p in tmp_path.iterdir()] == ["kept.jsonl"]
    S.save(results.limit(1), target)
    assert len(read_text(target).splitlines()) == 2


def test_json_lines(results, stats, tmp_path):
    options = S.ExportOptions(include_raw_html=True, include_links=False, include_images=True, max_content_length=4)
    path = S.save(results, str(tmp_path / "out.ndjson"), stats=stats, options=options)
    rows = [json.loads(x) for x in read_text(path).splitlines()]
    kinds = sorted(r["_type"] for r in rows)
    assert kinds == ["metadata", "result", "result", "stats"]
    first = next(r for r in rows if r.get("url") == "http://u/1")
    assert (first["content"], first["raw_html"], "links" in first, len(first["images"])) == ("He s", "<p>", False, 1)
    assert "raw_html" not in next(r for r in rows if r.get("url") == "http://u/2")


def test_indented_json_and_optional_fields(results, spark, tmp_path):
    rows = results.withColumn("llm_analysis", F.expr("if(url like '%1', map('k', 'v'), map())"))
    options = S.ExportOptions(include_raw_html=True, pretty_print=True)
    path = S.save(rows, str(tmp_path / "doc.json"), options=options)
    text = read_text(f"{path}/data")
    assert '\n  "url" : "http://u/1"' in text
    assert json.loads(read_text(f"{path}/metadata"))["total_results"] == 2
    compact = {}
    for row in R.json_line(rows).collect():
        record = json.loads(row.value)
        compact[record["url"]] = record
    assert (compact["http://u/1"]["raw_html"], compact["http://u/1"]["llm_analysis"]) == ("<p>", {"k": "v"})
    assert "raw_html" not in compact["http://u/2"] and "llm_analysis" not in compact["http://u/2"]
    only_one = R.json_line(rows.withColumn("raw_html", F.lit(None).cast("string"))).collect()
    assert all("raw_html" not in r.value for r in only_one) and any("llm_analysis" in r.value for r in only_one)


def test_markdown_report(results, stats, tmp_path):
    path = S.save(results, str(tmp_path / "report"), "markdown", stats=stats,
                  options=S.ExportOptions(max_content_length=10, include_metadata=False))
    parts = sorted(glob.glob(f"{path}/*"))
    report = "".join(read_text(p) for p in parts)
    links = "".join(f"- [{'t' * 50 if i else 'No text'}](/l{i})\n" for i in range(10))
    headings = "".join(f"- **H1:** {c}\n" for c in "abcde") + "- **H2:** s\n"
    assert report == (
        "# Web Scraping Results\n\n## Scraping Statistics\n\n| Metric | Value |\n|--------|-------|\n"
        "| Total Pages | 3 |\n| Successful | 2 |\n| Failed | 1 |\n| Success Rate | 66.7% |\n"
        "| Duration | 1.2 minutes |\n| Start URL | http://s |\n| Domain | s |\n\n---\n\n"
        "## Table of Contents\n\n1. [Title: Ä & co](#page-1-title-ä-co)\n2. [Page 2](#page-2-page-2)\n\n---\n\n## Pages\n\n"
        '<a id="page-1-title-ä-co"></a>\n## 1. Title: Ä & co\n\n**URL:** [http://u/1](http://u/1)\n\n'
        "**Description:** desc\n\n**Topics:** x, y\n\n**Content Type:** article\n\n\n### Summary\n\nSum\n\n"
        "\n### Content\n\nHe said \"h\n\n*[Content truncated...]*\n\n"
        f"\n### Page Headings\n\n{headings}\n\n### Links Found\n\n{links}\n*... and 2 more links*\n\n\n---\n\n"
        '<a id="page-2-page-2"></a>\n## 2. Page 2\n\n**URL:** [http://u/2](http://u/2)\n\n\n---\n\n')


def test_single_page_markdown(results, tmp_path):
    path = S.save(results, str(tmp_path / "one"), "markdown-single")
    assert read_text(path) == (
        "# Title: Ä & co\n\n> Source: [http://u/1](http://u/1)\n\n*Type: article | Topics: x, y*\n\n"
        f"## Summary\n\nSum\n\n## Content\n\n{FULL[2]}\n")
    empty = S.save(results.filter("false"), str(tmp_path / "none"), "markdown-single")
    assert read_text(empty) == "# No Results\n\nNo pages were scraped.\n"


def test_format_names():
    assert [S.format_for_extension(e) for e in (".JSON", "jsonl", "ndjson", "md", "markdown", "csv", "tsv", "txt")] == [
        "json", "jsonl", "jsonl", "markdown", "markdown", "csv", "tsv", "json"]
    assert S.with_extension("a/b", "markdown") == "a/b.md" and S.with_extension("a/b.txt", "csv") == "a/b.txt"
    with pytest.raises(ValueError, match="Unknown"):
        S.check_format("xlsx")


def test_records_with_statistics(spark, stats, tmp_path):
    pages = spark.createDataFrame([("u", "t", None)], "url string, title string, text string")
    path = S.save_with_stats(pages, stats, str(tmp_path / "crawl"))
    assert json.loads(read_text(f"{path}/data")) == {"url": "u", "record": {"title": "t", "text": None}}


def test_stream_equals_batch(spark, tmp_path):
    from pagewright.operators.content import extract_pages, to_results
    from pagewright.operators.links import extract_links
    from pagewright.sources.parse import parse_pages

    folder = str(tmp_path / "in")
    rows = spark.range(40).selectExpr(
        "id AS page_id", "concat('http://h', id % 4, '/p', id % 10, '?utm_source=', id) AS url",
        "concat('<title>', id, '</title><p>some text here</p><a href=\"/n', id, '\">x</a>') AS html")
    rows.repartition(5).write.parquet(folder)
    stream = T.stream_pages(spark, folder)

    def run(frame, name, mode="append"):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).option(
            "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    columns = ["page_id", "title", "text"]
    batch = sorted(map(tuple, extract_pages(parse_pages(rows)).select(columns).collect()))
    assert run(T.stream_records(stream).select(columns), "records") == batch
    assert run(T.stream_links(stream).select("page_id", "url"), "links") == sorted(
        map(tuple, extract_links(parse_pages(rows)).select("page_id", "url").collect()))
    assert len(run(T.dedup_stream(stream).select("url_norm"), "urls")) == 20
    assert run(T.running_counters(stream), "counters", "complete") == [(f"h{i}", 10, 10, 0) for i in range(4)]
    query = T.stream_save(to_results(T.stream_records(stream)), str(tmp_path / "json"), str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.json(str(tmp_path / "json")).count() == 40


def test_saving_does_not_change_options_and_keeps_crawls_apart(spark, tmp_path):
    from pagewright.operators import stats as A
    from pagewright.sinks import rows as R
    from pagewright.sinks import save as S

    options = S.ExportOptions()
    rows = spark.createDataFrame([("u", "t")], "url string, title string")
    S.save(rows, str(tmp_path / "a.tsv"), options=options)
    assert options == S.ExportOptions()
    stats = A.complete_stats(spark.createDataFrame([("http://a", 1), ("http://b", 2)], "start_url string, total_pages long"))
    texts = [r.value for r in R.stats_preamble_text(stats).collect()]
    assert len(texts) == 2 and all(t.startswith("# Statistics\n# total_pages,") and t.count("\n") == 16 for t in texts)


def test_flat_columns_have_a_limit(spark, monkeypatch):
    import pytest

    from pagewright.sinks import rows as R

    rows = spark.createDataFrame([({f"k{i}": "v" for i in range(9)},)], "headings map<string,string>")
    assert R.discover_columns(rows)["headings"] == [f"k{i}" for i in range(9)]
    monkeypatch.setattr(R, "MAX_FLAT_COLUMNS", 5)
    with pytest.raises(ValueError):
        R.discover_columns(rows)


def test_a_report_is_in_order_after_one_sort(spark, tmp_path):
    import random

    from pagewright.operators import content as C

    ids = list(range(500))
    random.Random(1).shuffle(ids)
    pages = spark.createDataFrame([(i, f"http://u/{i}", f"Page {i}", "text") for i in ids], "page_id long, url string, title string, main_content string")
    rows = C.to_results(pages.selectExpr("*", "'' AS text", "'' AS meta_description")).repartition(6)
    path = S.save(rows, str(tmp_path / "long"), "markdown")
    contents, written = (read_text(f"{path}/{name}") for name in ("2-contents", "4-pages"))
    assert [int(x.split(".")[0]) for x in contents.splitlines() if x[:1].isdigit()] == list(range(1, 501))
    assert [int(x.split("/")[-1].rstrip(")")) for x in written.splitlines() if x.startswith("**URL:**")] == sorted(ids)

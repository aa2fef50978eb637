"""Queries over texts: truncation, slugs, durations, prompts and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import core as K
from pagewright.functions import nodes as N
from pagewright.functions import text as X
from pagewright.operators import annotate as M
from pagewright.operators import answers as A
from pagewright.operators import content as C
from pagewright.operators import links as L
from pagewright.plans import oracle as O
from pagewright.plans.link_queries import links
from pagewright.plans.page_queries import parsed, records, table
from pagewright.session import scratch_folder


def collapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{K.collapse_spaces('text')} AS text")


def truncated_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{K.truncate('text', 300)} AS cut", f"{X.for_model('text', 1000)} AS model_input",
        f"{X.for_export('text', 200)} AS export_text", f"{X.short_summary('text', 150)} AS summary")


def page_anchors(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{X.page_anchor('text', 'doc_id')} AS anchor")


def durations(spark, sf_dir):
    """Duration and percent texts of numbers from the event log, ties included."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id % 130 + (event_id % 4) * 0.25D AS short", "event_id * 7.5D AS long", "value")
    return rows.selectExpr(
        "event_id", f"{X.duration_text('short')} AS short_text", f"{X.duration_text('long')} AS long_text",
        f"{X.duration_text_1('short')} AS short_text_1", f"{X.duration_text_1('long')} AS long_text_1",
        f"{X.percent_text('event_id % 17', 'event_id % 40')} AS percent")


def indicator_hits(spark, sf_dir):
    """Noise indicators in document sources and texts."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{K.contains_any('lower(text)', N.NOISE_INDICATORS)} AS has_any",
        f"{K.count_contained('lower(text)', N.NOISE_INDICATORS)} AS hits")


def joined_cells(spark, sf_dir):
    """Lists and maps as cells."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "split(source, '[^a-z0-9]+') AS parts", "map('lang', lang, 'chars', cast(n_chars as string)) AS facts")
    return rows.selectExpr("doc_id", f"{X.join_values('parts')} AS parts", f"{X.join_entries('facts')} AS facts")


def content_prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return M.content_prompts(rows, goal="prices", max_length=2000).select("page_id", "prompt")


def link_prompts(spark, sf_dir):
    found = parsed(spark, sf_dir)
    both = M.link_prompts(found, top=3, context=M.page_context("url", "''")).withColumn("kind", F.lit("compact"))
    return both.unionByName(M.link_prompts(found, goal="news", top=30, compact=False).withColumn("kind", F.lit("wide")))


def summary_prompts(spark, sf_dir):
    return M.summary_prompts(table(spark, sf_dir, "documents"), "text", 200).select("doc_id", "prompt")


def summaries(spark, sf_dir):
    """Documents with a label keep their model summary, the others fall back to the start of the text."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").selectExpr(
        "doc_id", "text", "if(quality = 1, concat('S ', text), null) AS answer")
    kept = M.with_summaries(rows, "text", "answer", 100).select("doc_id", F.col("summary").alias("start"))
    return kept.join(M.with_summaries(rows, "text", "answer", 100, on_failure="empty").select(
        "doc_id", F.col("summary").alias("strict")), "doc_id")


def _answers(spark, sf_dir):
    """Model answers derived from the documents, in five shapes by language and length."""
    body = ("to_json(named_struct('title', source, 'main_content', text, 'summary', left(text, 20), "
            "'topics', array(lang, source), 'confidence_score', cast(n_chars % 100 / 100D as string)))")
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"""CASE doc_id % 5
        WHEN 0 THEN {body} WHEN 1 THEN concat('Here you are:\\n```json\\n', {body}, '\\n```\\nDone.')
        WHEN 2 THEN concat('The answer is ', {body}, ' as asked.') WHEN 3 THEN concat('No answer for ', lang)
        ELSE '{{"title": null, "confidence_score": "high"}}' END AS body""")


def content_responses(spark, sf_dir):
    found = M.parse_content_responses(_answers(spark, sf_dir))
    return found.select("doc_id", "title", "main_content", "summary", F.array_join("topics", "|").alias("topics"),
                        "author", "content_type", "confidence_score", "extraction_notes")


def strict_content_responses(spark, sf_dir):
    found = M.parse_content_responses(_answers(spark, sf_dir), strict=True)
    return found.select("doc_id", "title", "summary", "content_type", "confidence_score", "extraction_notes")


def _score_answers(spark, sf_dir):
    """One answer per event: a scored link, wrapped in text or not."""
    return table(spark, sf_dir, "events").selectExpr("event_id", """concat(if(event_type = 'view', 'Sure: ', ''),
        '{"links": [{"url": "/', event_type, '", "relevance_score": ', value / 1000, ', "priority": "2"}, {"url": "/u',
        user_id, '", "relevance_score": ', if(event_type = 'error', '"bad"', '0.25'),
        ', "link_type": "news", "should_follow": false}]}') AS body""")


def link_scores(spark, sf_dir):
    return M.parse_link_scores(_score_answers(spark, sf_dir)).select(
        "event_id", "place", "url", F.round("relevance_score", 6).alias("relevance_score"), "priority",
        "link_type", "should_follow")


def strict_link_scores(spark, sf_dir):
    return M.parse_link_scores(_score_answers(spark, sf_dir), strict=True).select(
        "event_id", "place", "url", "priority", "should_follow")


def fallback_scores(spark, sf_dir):
    found = links(spark, sf_dir)
    everything = M.fallback_scores(found).groupBy("page_id").agg(
        F.count("*").alias("links"), F.sum("relevance_score").alias("score"))
    sent = M.fallback_scores(L.extract_links(parsed(spark, sf_dir), top=4)).groupBy("page_id").agg(F.count("*").alias("sent"))
    return everything.join(sent, "page_id")


def merged_annotations(spark, sf_dir):
    """Page records with model fields from the documents of the same number."""
    answers = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").selectExpr(
        "doc_id AS page_id", "if(quality = 1, text, '') AS main_content", "source AS title",
        "if(toxic = 1, lang, null) AS author", "cast(null as string) AS date_published",
        "left(text, 10) AS summary", "if(quality = 1, 'article', '') AS content_type")
    merged = M.merge_annotations(records(spark, sf_dir), answers)
    return merged.select("page_id", "title", "main_content", "author", "date_published", "summary", "content_type")


def annotated_pages(spark, sf_dir):
    """A caller's function over Arrow batches: here the length and the last word of each text."""
    def last_word(batch):
        words = batch["text"].str.split()
        return batch[["doc_id"]].assign(
            n=batch["text"].str.len(), word=[w[-1] if w else "" for w in words])

    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.annotate(rows, last_word, "doc_id long, n long, word string")


def stored_answers(spark, sf_dir):
    """Answers about the documents' kinds: asked once per kind, and from the store when the model is gone."""
    prompts = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('Rate ', lang, ' from ', source) AS prompt")
    store = scratch_folder(spark, "answers")
    A.ask(prompts, lambda asked: [p.upper() for p in asked], store).select("doc_id").write.format("noop").mode("overwrite").save()
    return A.ask(prompts, lambda asked: [None for _ in asked], store).select("doc_id", "answer")


def plain_text(spark, sf_dir):
    """Entity decoding and tag removal over whole documents wrapped in markup."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat('<p class=\"x\">', replace(text, ' ', '&amp; '), '</p>&copy;') AS html")
    return rows.select("doc_id", C.strip_tags("html").alias("text"))


QUERIES = {f.__name__: f for f in (
    collapsed_text, truncated_text, page_anchors, durations, indicator_hits, joined_cells, content_prompts,
    link_prompts, summary_prompts, summaries, content_responses, strict_content_responses, link_scores,
    strict_link_scores, fallback_scores, merged_annotations, annotated_pages, stored_answers, plain_text,
)}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_L = "WITH " + O.LINKS


def _duration(value: str, digits: int) -> str:
    small = f"printf('%.{digits}f', {value}::DOUBLE)"
    minutes = f"printf('%.{digits}f', {value}::DOUBLE / 60)"
    return (f"CASE WHEN {value} < 60 THEN {small} || ' seconds' WHEN {value} < 3600 THEN {minutes} || ' minutes' "
            f"ELSE printf('%.1f', {value}::DOUBLE / 3600) || ' hours' END")


_OK_ANSWER = "doc_id % 5 < 3"
_INDICATORS = [f"(contains(lower(text), '{w}'))::INT" for w in N.NOISE_INDICATORS]

ORACLE = {
    "collapsed_text": f"SELECT doc_id, {O.collapsed('text')} AS text FROM documents",
    "truncated_text": """SELECT doc_id, left(text, 300) AS cut, CASE WHEN length(text) > 1000 THEN left(text, 900) ||
        chr(10) || chr(10) || '[Content truncated...]' ELSE text END AS model_input,
        CASE WHEN length(text) > 200 THEN left(text, 200) || chr(10) || chr(10) || '*[Content truncated...]*' ELSE text END
        AS export_text, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS summary FROM documents""",
    "page_anchors": """SELECT doc_id, 'page-' || doc_id || CASE WHEN slug = '' THEN '' ELSE '-' || left(slug, 30) END AS anchor
        FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g')
        AS slug FROM documents)""",
    "durations": f"""WITH t AS (SELECT event_id, event_id % 130 + (event_id % 4) * 0.25 AS short, event_id * 7.5 AS long
        FROM events) SELECT event_id, {_duration('short', 0)} AS short_text, {_duration('long', 0)} AS long_text,
        {_duration('short', 1)} AS short_text_1, {_duration('long', 1)} AS long_text_1,
        printf('%.1f%%', (event_id % 17)::DOUBLE / greatest(event_id % 40, 1) * 100) AS percent FROM t""",
    "indicator_hits": f"""SELECT doc_id, {' + '.join(_INDICATORS)} > 0 AS has_any, {' + '.join(_INDICATORS)} AS hits
        FROM documents""",
    "joined_cells": """SELECT doc_id, regexp_replace(source, '[^a-z0-9]+', '; ', 'g') AS parts,
        'lang: ' || lang || '; chars: ' || n_chars AS facts FROM documents""",
    "content_prompts": f"""SELECT page_id, {_sql(M.CONTENT_PROMPT_START)} || url || {_sql(M.CONTENT_PROMPT_GOAL + 'prices' + M.CONTENT_PROMPT_END)}
        || CASE WHEN length(html) > 2000 THEN left(html, 1900) || chr(10) || chr(10) || '[Content truncated...]' ELSE html END
        AS prompt FROM pages""",
    "link_prompts": f"""{_L}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) AS i FROM l)
        SELECT page_id, 'compact' AS kind, {_sql(M.LINK_PROMPT_START)} || 'Title: ' || any_value(page_url) || chr(10) || 'Summary: '
        || {_sql(M.LINK_PROMPT_END)} || string_agg('- ' || norm || ': ' || text, chr(10) ORDER BY n) AS prompt
        FROM k WHERE i <= 3 GROUP BY page_id UNION ALL
        SELECT page_id, 'wide', {_sql(M.LINK_PROMPT_START + M.LINK_PROMPT_GOAL + 'news' + M.LINK_PROMPT_END)} || chr(10) || chr(10)
        || string_agg('- URL: ' || norm || ' | Text: ' || text, chr(10) ORDER BY n) FROM k WHERE i <= 30 GROUP BY page_id""",
    "summary_prompts": """SELECT doc_id, 'Summarize the following content in 200 characters or less:' || chr(10) || chr(10) ||
        text || chr(10) || chr(10) || 'Summary:' AS prompt FROM documents""",
    "summaries": """SELECT doc_id, CASE WHEN quality = 1 THEN left('S ' || text, 100) WHEN length(text) > 100
        THEN left(text, 100) || '...' ELSE text END AS start,
        CASE WHEN quality = 1 THEN left('S ' || text, 100) ELSE '' END AS strict
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "content_responses": f"""SELECT doc_id, CASE WHEN {_OK_ANSWER} THEN source ELSE '' END AS title,
        CASE WHEN {_OK_ANSWER} THEN text ELSE '' END AS main_content,
        CASE WHEN {_OK_ANSWER} THEN left(text, 20) ELSE 'Error: No JSON found in response' END AS summary,
        CASE WHEN {_OK_ANSWER} THEN lang || '|' || source ELSE '' END AS topics, CAST(NULL AS VARCHAR) AS author,
        CASE WHEN {_OK_ANSWER} THEN 'unknown' ELSE 'article' END AS content_type,
        CASE WHEN {_OK_ANSWER} THEN (n_chars % 100) / 100.0 ELSE 0 END::DOUBLE AS confidence_score,
        '' AS extraction_notes FROM documents""",
    "strict_content_responses": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN source ELSE '' END AS title,
        CASE WHEN doc_id % 5 = 0 THEN left(text, 20) ELSE '' END AS summary,
        CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'article' END AS content_type,
        CASE WHEN doc_id % 5 = 0 THEN (n_chars % 100) / 100.0 ELSE 0 END::DOUBLE AS confidence_score,
        CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Extraction failed: No JSON found in response' END AS extraction_notes
        FROM documents""",
    "link_scores": """SELECT event_id, 0 AS place, '/' || event_type AS url, round(value / 1000, 6) AS relevance_score,
        2 AS priority, 'unknown' AS link_type, true AS should_follow FROM events WHERE event_type <> 'error'
        UNION ALL SELECT event_id, 1, '/u' || user_id, 0.25, 5, 'news', false FROM events WHERE event_type <> 'error'""",
    "strict_link_scores": """SELECT event_id, 0 AS place, '/' || event_type AS url, 2 AS priority, false AS should_follow
        FROM events WHERE event_type NOT IN ('error', 'view') UNION ALL SELECT event_id, 1, '/u' || user_id, 5, false
        FROM events WHERE event_type NOT IN ('error', 'view')""",
    "fallback_scores": f"""{_L} SELECT page_id, count(*) AS links, count(*) * 0.5::DOUBLE AS score,
        least(count(*), 4) AS sent FROM l GROUP BY page_id""",
    "merged_annotations": f"""WITH {O.PAGES}, d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
        SELECT page_id, coalesce(nullif(source, ''), {O.stripped(O.decoded("regexp_extract(body, '<title>([^<]*)', 1)"))}) AS title,
        CASE WHEN quality = 1 AND text <> '' THEN text ELSE {O.text('article', ' ')} END AS main_content,
        CASE WHEN toxic = 1 THEN lang END AS author, CAST(NULL AS VARCHAR) AS date_published,
        coalesce(left(text, 10), '') AS summary, CASE WHEN quality = 1 THEN 'article' ELSE 'unknown' END AS content_type
        FROM p LEFT JOIN d ON page_id = doc_id""",
    "annotated_pages": f"""SELECT doc_id, length(text) AS n,
        regexp_extract({O.stripped('text')}, '([^\\s]*)$', 1) AS word FROM documents""",
    "stored_answers": "SELECT doc_id, upper('Rate ' || lang || ' from ' || source) AS answer FROM documents",
    "plain_text": f"""SELECT doc_id, {O.stripped(O.collapsed(O.decoded(
        "regexp_replace('<p class=.x.>' || replace(text, ' ', '&amp; ') || '</p>&copy;', '<[^>]+>', ' ', 'g')")))} AS text
        FROM documents""",
}

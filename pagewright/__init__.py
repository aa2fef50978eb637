"""Analytics over tables of fetched web pages, as Spark DataFrame operators."""

from pagewright.operators.annotate import (
    annotate, content_prompts, fallback_scores, link_prompts, merge_annotations, merge_scores,
    parse_content_responses, parse_link_scores, summary_prompts, with_summaries,
)
from pagewright.operators.answers import ask
from pagewright.operators.content import (
    basic_record, extract_pages, min_content, page_record, strip_tags, text_only, to_results,
)
from pagewright.operators.crawl import bounded_crawl, crawl
from pagewright.operators.links import (
    absolute_links, content_links, external, extract_links, followable, hostname_links, internal, link_counts,
    public_columns, same_domain_links, unique_urls,
)
from pagewright.operators.ordering import number_rows, schedule, top_per_page, waves
from pagewright.operators.stats import bounded_stats, crawl_stats, export_stats, to_export_stats
from pagewright.sinks.save import ExportOptions, save, save_with_stats
from pagewright.sources.pages import (
    document_kind, drop_challenge_pages, fetch_outcomes, ok_status, read_pages, spread,
)
from pagewright.sources.parse import parse_pages
from pagewright.streaming.pages import dedup_stream, running_counters, stream_pages, stream_save
from pagewright.streaming.state import dedup_arrivals, read_upserted, rocksdb_state, stream_outcomes, upsert

__all__ = [
    "ExportOptions", "absolute_links", "annotate", "ask", "basic_record", "bounded_crawl", "bounded_stats",
    "content_links", "content_prompts", "crawl", "crawl_stats", "dedup_arrivals", "dedup_stream", "document_kind",
    "drop_challenge_pages", "export_stats", "external", "extract_links", "extract_pages", "fallback_scores",
    "fetch_outcomes", "followable", "hostname_links", "internal", "link_counts", "link_prompts",
    "merge_annotations", "merge_scores", "min_content", "number_rows", "ok_status", "page_record", "parse_content_responses",
    "parse_link_scores", "parse_pages", "public_columns", "read_pages", "read_upserted", "rocksdb_state", "running_counters", "same_domain_links",
    "save", "save_with_stats", "schedule", "spread", "stream_outcomes", "stream_pages", "stream_save", "strip_tags",
    "summary_prompts", "text_only", "to_export_stats", "to_results", "top_per_page", "unique_urls", "upsert", "waves",
    "with_summaries",
]

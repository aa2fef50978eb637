"""Registered queries: each composes operators over the given tables."""

from pagewright.plans import crawl_queries, export_queries, link_queries, page_queries, text_queries

_MODULES = (page_queries, link_queries, crawl_queries, text_queries, export_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}

"""All registered queries of the library's own operators, by name."""

from __future__ import annotations

from narrata.plans import article_queries, book_queries, job_queries, media_queries, stream_queries, text_queries, work_queries

MODULES = [text_queries, book_queries, media_queries, job_queries, stream_queries, article_queries, work_queries]
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL

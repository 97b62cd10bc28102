"""All queries over the sample tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans import books, check_queries, flow_queries, markup_queries, page_queries, parser_queries, stream_queries, text_queries, toc_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (books, text_queries, toc_queries, page_queries, flow_queries, parser_queries, stream_queries, markup_queries, check_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL

FLAGSHIP = "toc_page_detect"

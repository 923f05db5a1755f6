"""Queries over the driver's tables, one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> tuple[dict[str, Query], dict[str, str]]:
    from . import audit_queries, interval_queries, matching_queries, metric_queries, report_queries, selection_queries, sequence_queries, store_queries

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (interval_queries, sequence_queries, matching_queries, metric_queries, selection_queries, audit_queries, report_queries, store_queries):
        queries |= module.BOOK.queries
        sql |= module.BOOK.sql
    return queries, sql


def queries() -> dict[str, Query]:
    return _all()[0]


def oracle_sql() -> dict[str, str]:
    return _all()[1]

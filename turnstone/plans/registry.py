"""Registered queries of the session analytics, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name; sql: what DuckDB runs for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from turnstone.plans import catalog_queries, join_queries, match_queries, record_queries, rule_queries, session_queries, source_queries, text_queries  # noqa: E402, F401

"""Registering queries with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registry() -> tuple[dict, dict, Callable]:
    """(queries, SQL, decorator). The decorator takes the SQL, or nothing where SQL can't say it."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None, name: str | None = None):
        def wrap(f):
            key = name or f.__name__
            queries[key] = f
            if text:
                sql[key] = " ".join(text.split())
            return f

        return wrap

    return queries, sql, query

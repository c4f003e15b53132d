"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = "") -> Callable:
    """Registers a function (spark, sf_dir) under its name; ``views`` names the views that ``sql`` uses."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            # a query that adds expressions of its own begins with a comma
            ORACLE_SQL[f.__name__] = with_views(sql, *views.split()) if views else sql
        return f

    return add

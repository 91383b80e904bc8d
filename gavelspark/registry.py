"""Where queries and the SQL that states the same result are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, over: str = "", name: str | None = None):
    """Register a query under its function's name; `over` goes before sql as a WITH clause."""

    def add(f):
        own = name or f.__name__
        QUERIES[own] = f
        if sql is not None:
            ORACLES[own] = f"WITH {over}\n{sql}" if over else sql
        return f

    return add

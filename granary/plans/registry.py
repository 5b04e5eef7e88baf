"""All registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL where SQL can express it over whole tables."""

    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


from granary.plans import core  # noqa: E402, F401 - registers the queries

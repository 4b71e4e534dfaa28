"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.session import attach

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is covered by the tests only."""

    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(attach(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


def r6(column: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, as both engines are compared."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), 6).alias(name or column)


def joined(column: Column | str, name: str) -> Column:
    """A list of texts as one text."""
    return F.array_join(column, " | ").alias(name)


def big(column: Column | str, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint").alias(name or column)

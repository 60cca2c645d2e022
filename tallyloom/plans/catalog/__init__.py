"""One runnable query per operator, each with the SQL it must agree with.

A query takes (spark, folder of the tables) and returns a DataFrame over whole tables. ``SQL`` holds the equivalent
statement for an independent engine; queries without one are checked against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its equivalent SQL."""

    def register(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__!r} is registered twice")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> None:
    """Import every query module."""
    from tallyloom.plans.catalog import (  # noqa: F401
        aggregates,
        changes,
        comparison,
        fields,
        joining,
        ordering,
        paging,
        projection,
        reports,
        reshaping,
        scalars,
        setops,
        streams,
    )

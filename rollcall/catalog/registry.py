"""Names of the queries, their functions and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that checks it."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        ORACLE[key] = sql
        return function

    return register

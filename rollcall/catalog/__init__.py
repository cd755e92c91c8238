"""Queries over the driver's tables, each with the SQL that checks it."""

from rollcall.catalog import (  # noqa: F401 - importing registers the queries
    cleaning_queries,
    collate_queries,
    file_queries,
    function_queries,
    participation_queries,
)
from rollcall.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

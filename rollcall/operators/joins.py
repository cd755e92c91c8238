"""Joins to a side that is small in most surveys, but need not be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.columns import col
from rollcall.session import once

#: Most bytes of rows that are sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows held in memory: their text, and some bytes per field."""
    fixed = 16 * (len(df.columns) + 1)
    text = [
        F.coalesce(F.octet_length(col(f.name)), F.lit(0)).cast("bigint")
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    ]
    per_row = sum(text, F.lit(fixed).cast("bigint"))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame) -> bool:
    return measured_bytes(df) <= BROADCAST_BYTES


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a computed side: by broadcast if its measured size allows.

    Then the large side is not shuffled at all. Otherwise both are, and a key with
    very many rows is split among tasks by the adaptive skew join.
    """
    return df.join(F.broadcast(small) if fits_broadcast(small) else small, list(keys), how)


def join_aggregate(rows: DataFrame, aggregate: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to an aggregate made from them by the same keys.

    The aggregate is computed first. Planned together, both would share one shuffle with the aggregate
    between it and the join, and a join with anything below it but a shuffle is not split at hot keys.
    """
    return join_small(rows, once(aggregate), keys, how)

"""Joins of wide rows with a list of ids whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.session import once

#: Ids (8 bytes each) that may be sent to all executors; more go through a shuffle.
BROADCAST_IDS = 2_000_000


def sized(ids: DataFrame) -> DataFrame:
    """The ids, stored and counted; marked for broadcast if they are few enough."""
    stored = once(ids)
    return F.broadcast(stored) if stored.count() <= BROADCAST_IDS else stored


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among ``ids`` (column ``id``). Null keys stay."""
    return df.join(sized(ids.select(F.col("id").alias(key)).distinct()), key, "left_anti").select(*df.columns)

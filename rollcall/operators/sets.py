"""Stacking of tables with differing columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.columns import col


def column_union(frames: Sequence[DataFrame]) -> list[str]:
    """All column names, each at the place where it is first seen."""
    return list(dict.fromkeys(c for df in frames for c in df.columns))


def union_rows(*frames: DataFrame) -> DataFrame:
    """Stack frames of one schema, pairing them up so the plan stays shallow."""
    level = list(frames)
    while len(level) > 1:
        paired = [a.union(b) for a, b in zip(level[::2], level[1::2])]
        level = paired + level[len(paired) * 2 :]
    return level[0]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; absent or null text is ``''``."""
    if not frames:
        raise ValueError("nothing to stack")
    columns = column_union(frames)
    check_case(frames[0], columns)
    types = {f.name: f.dataType for df in reversed(frames) for f in df.schema.fields}
    return union_rows(*[_widen(df, columns, types) for df in frames])


def check_case(df: DataFrame, columns: Sequence[str]) -> None:
    """Refuse names that differ by case alone unless the session tells them apart."""
    if len({c.lower() for c in columns}) == len(columns):
        return
    if df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        raise ValueError("column names differ by case only: set spark.sql.caseSensitive=true")


def _widen(df: DataFrame, columns: Sequence[str], types: dict[str, T.DataType]) -> DataFrame:
    own = set(df.columns)
    out = []
    for c in columns:
        value = col(c) if c in own else F.lit(None).cast(types[c])
        if isinstance(types[c], T.StringType):
            value = F.coalesce(value, F.lit("")) if c in own else F.lit("")
        out.append(value.alias(c))
    return df.select(*out)

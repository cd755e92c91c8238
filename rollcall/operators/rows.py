"""Row filters and column projections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.columns import (
    AUDIO_KINDS,
    DEFAULT_COLUMNS,
    END_TIME,
    INCENTIVES,
    ORD,
    TRANSCRIPT_COLUMNS,
    SurveyColumns,
    col,
    order_names,
    order_value,
)
from rollcall.functions.dates import DAY_SHAPE
from rollcall.functions.text import empty_default, ws_trim
from rollcall.session import once


def end_time_rows(df: DataFrame, cols: SurveyColumns = DEFAULT_COLUMNS) -> DataFrame:
    return df.filter(col(cols.kind) == END_TIME)


def incentive_rows(df: DataFrame, cols: SurveyColumns = DEFAULT_COLUMNS) -> DataFrame:
    return df.filter((col(cols.kind) == INCENTIVES) & (col(cols.response) != ""))


def audio_rows(df: DataFrame, cols: SurveyColumns = DEFAULT_COLUMNS) -> DataFrame:
    return df.filter(col(cols.kind).isin(*AUDIO_KINDS))


def valid_days(df: DataFrame, day_col: str = "day") -> DataFrame:
    """Rows that have a day at all, well formed or not."""
    return df.filter(col(day_col) != "")


def with_reference(df: DataFrame, cols: SurveyColumns = DEFAULT_COLUMNS) -> DataFrame:
    if cols.reference not in df.columns:
        return df.limit(0)
    return df.filter(F.length(ws_trim(col(cols.reference))) > 0)


def for_participant(
    df: DataFrame, pid: str | None, cols: SurveyColumns = DEFAULT_COLUMNS
) -> DataFrame:
    """Rows of one participant; None means all of them."""
    return df if pid is None else df.filter(col(cols.participant) == pid)


def select_or_empty(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns; one that is absent, or null in a row, is ``''``."""
    return df.select(
        *[
            (empty_default(col(n)) if n in df.columns else F.lit("")).alias(n)
            for n in names
        ]
    )


def transcripts(df: DataFrame, cols: SurveyColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Date, reference and transcript of the rows that have a reference."""
    kept = select_or_empty(
        with_reference(df, cols), (cols.date, cols.reference, cols.transcript)
    )
    return kept.toDF(*TRANSCRIPT_COLUMNS)


def ensure_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the named columns that are absent, filled with ``''``."""
    return df.withColumns({n: F.lit("") for n in names if n not in df.columns})


def keys_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.select(*[col(c) for c in [*dict.fromkeys(keys), *rest]])


def unpivot_days(wide: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Wide summary back to one row per id and day, from its ``YYYY-MM-DD`` columns."""
    days = day_columns(wide)
    return wide.unpivot([col(c) for c in id_cols], [col(d) for d in days], "day", "n")


def day_columns(wide: DataFrame) -> list[str]:
    """Names of the day columns, newest first."""
    return sorted((c for c in wide.columns if re.match(DAY_SHAPE, c)), reverse=True)


def report_columns(
    wide: DataFrame, total: str = "TotalEntries", include_incentive: bool = False
) -> DataFrame:
    """Columns of the report: participant, total, days newest first; empty is 0."""
    days = day_columns(wide)
    incentive = ["Incentive"] if include_incentive and "Incentive" in wide.columns else []
    counts = [F.coalesce(col(c), F.lit(0)).alias(c) for c in [total, *days]]
    head, *cells = counts
    return wide.select(
        col("ParticipantID"), head, *[col(c) for c in incentive], *cells
    )


def in_input_order(df: DataFrame, order_by: Sequence[str] = ORD) -> DataFrame:
    """Globally sorted as read: a range-partitioned sort, so no task sees all rows."""
    return df.orderBy(*[col(c) for c in order_names(order_by)])


def preview(df: DataFrame, n: int, order_by: Sequence[str] = ORD) -> DataFrame:
    """First ``n`` rows. Each task keeps only its own first ``n``."""
    return in_input_order(df, order_by).limit(n)


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def first_seen(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Earliest place of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    place: Column = F.min(order_value(order_names(order_by)))
    return df.groupBy(*[col(k) for k in keys]).agg(place.alias("first_ord"))


def numbered(ordered: DataFrame, name: str = "position") -> DataFrame:
    """The rows of a sorted frame with their places, from 0, without one task that sees all of them.

    The rows are stored as sorted; rows of each task are counted, and each adds those of the tasks before.
    """
    stored = once(ordered.withColumn("__at", F.monotonically_increasing_id())).withColumn("__task", F.shiftright("__at", 33))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    tasks = stored.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    tasks = tasks.select("__task", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = stored.join(F.broadcast(tasks), "__task")
    return joined.withColumn(name, col("__at") - col("__first") + col("__before")).drop("__at", "__task", "__first", "__before")

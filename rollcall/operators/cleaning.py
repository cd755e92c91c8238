"""Repeats left by upload retries: same prompt, participant and answer time.

Repeats are rare beside the answers, so they are found first, on the keys alone:
a pass that shuffles one number per key. The wide rows then meet a small table of
repeated keys and are not shuffled, unless that table turns out not to be small.

Rows with a blank key are never repeats and take no part in any of this, so the
blank key, which may be the largest of all, is no group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.columns import DEFAULT_COLUMNS, ORD, col, order_names, order_value, require_columns
from rollcall.functions.text import has_blank_key, is_blank_word
from rollcall.operators.dedup import first_per_key
from rollcall.operators.joins import fits_broadcast, join_aggregate, join_small
from rollcall.operators.sets import union_rows
from rollcall.session import once

KEYS = DEFAULT_COLUMNS.cleaning_keys

# Status words of the review.
KEPT = "Kept (earliest)"
REMOVED = "Removed"


def _exempt(keys: Sequence[str], date_col: str, require_date: bool) -> Column:
    blank = has_blank_key([col(k) for k in keys])
    return blank | is_blank_word(col(date_col)) if require_date else blank


def _collated(date_col: str) -> Column:
    """Upload time in dictionary order, in which ``T1:00`` comes before ``T10:00``."""
    return F.collate(F.coalesce(col(date_col), F.lit("")), "UNICODE")


def repeated_keys(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date_col: str = DEFAULT_COLUMNS.date,
    order_by: Sequence[str] = ORD,
    require_date: bool = False,
) -> DataFrame:
    """Per key with more than one row: its size, upload times, first place and kept place.

    A hash of the keys is counted first. Keys that share a hash by chance are told
    apart by the second step, which groups the few rows left by the keys themselves.
    The result is computed here; hand it to the functions below to share it.
    """
    order = order_names(order_by)
    require_columns(df, [*keys, date_col])
    rows = df.filter(~_exempt(keys, date_col, require_date)).select(
        *[col(k) for k in dict.fromkeys([*keys, date_col, *order])],
        F.xxhash64(*[col(k) for k in keys]).alias("__hash"),
    )
    hashes = rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__hash")
    place = order_value(order)
    groups = (
        join_small(rows, once(hashes), ["__hash"], "left_semi")
        .groupBy(*[col(k) for k in keys])
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.count_distinct(F.coalesce(col(date_col), F.lit(""))).alias("__dates"),
            F.min(place).alias("__first"),
            F.min_by(place, F.struct(_collated(date_col), place)).alias("__keep"),
        )
        .filter(col("__n") > 1)
    )
    return once(groups)


def clean(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date_col: str = DEFAULT_COLUMNS.date,
    order_by: Sequence[str] = ORD,
    require_date: bool = False,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """The earliest upload of each key, and every row with a blank key.

    ``require_date`` also exempts rows without an upload time; otherwise such a
    row counts as the earliest.
    """
    order = order_names(order_by)
    if repeated is None:
        repeated = repeated_keys(df, keys, date_col, order, require_date)
    groups = repeated.select(*[col(k) for k in keys], F.lit(True).alias("__repeated"))
    exempt = _exempt(keys, date_col, require_date)
    sort = [_collated(date_col), *[col(c) for c in order]]
    if not fits_broadcast(groups):
        # Many repeats: one row per key and task is left before the shuffle.
        earliest = first_per_key(df.filter(~exempt), [col(k) for k in keys], sort)
        return union_rows(df.filter(exempt), earliest)
    # Rows are told apart by key alone: places may differ between two scans of the same files.
    met = df.join(F.broadcast(groups), list(keys), "left")
    again = col("__repeated").isNotNull() & ~exempt
    columns = [col(c) for c in df.columns]
    earliest = first_per_key(met.filter(again).select(*columns), [col(k) for k in keys], sort)
    return union_rows(met.filter(~again).select(*columns), earliest)


def members(
    df: DataFrame,
    groups: DataFrame,
    keys: Sequence[str] = KEYS,
    date_col: str = DEFAULT_COLUMNS.date,
    order_by: Sequence[str] = ORD,
    require_date: bool = False,
) -> DataFrame:
    """Rows of repeated keys with their status and the first place of their key.

    They are stored, whole rows, so that places are compared within one scan of the survey. The place that
    stays is computed before it meets the rows, and a key with very many of them is split.
    """
    order = order_names(order_by)
    small = groups.select(*[col(k) for k in keys], "__first")
    rows = once(join_small(df.filter(~_exempt(keys, date_col, require_date)), small, keys))
    place = order_value(order)
    earliest = rows.groupBy(*[col(k) for k in keys]).agg(
        F.min_by(place, F.struct(_collated(date_col), place)).alias("__keep")
    )
    status = F.when(place == col("__keep"), KEPT).otherwise(REMOVED)
    joined = join_aggregate(rows, earliest, keys)
    return joined.select(status.alias("Status"), *[col(c) for c in df.columns], "__first")


def clean_removed(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date_col: str = DEFAULT_COLUMNS.date,
    order_by: Sequence[str] = ORD,
    require_date: bool = False,
    repeated: DataFrame | None = None,
    marked: DataFrame | None = None,
) -> DataFrame:
    """The rows that ``clean`` leaves out. ``marked``: the rows of repeated keys, if known already."""
    if marked is None:
        if repeated is None:
            repeated = repeated_keys(df, keys, date_col, order_by, require_date)
        marked = members(df, repeated, keys, date_col, order_by, require_date)
    return marked.filter(col("Status") == REMOVED).drop("Status", "__first")


def clean_review(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date_col: str = DEFAULT_COLUMNS.date,
    order_by: Sequence[str] = ORD,
    require_date: bool = False,
    groups: int | None = None,
    repeated: DataFrame | None = None,
    marked: DataFrame | None = None,
) -> DataFrame:
    """All rows of repeated keys with their status, groups as first seen.

    ``groups`` limits the report to the groups that come first.
    """
    order = order_names(order_by)
    if repeated is None and (marked is None or groups is not None):
        repeated = repeated_keys(df, keys, date_col, order, require_date)
    if groups is not None:
        shown = repeated.orderBy("__first").limit(groups)
        marked = members(df, shown, keys, date_col, order, require_date)
    elif marked is None:
        marked = members(df, repeated, keys, date_col, order, require_date)
    # The sort samples its input first. Spread by place, the rows shown are read from this shuffle both times.
    spread = marked.repartition(*[col(c) for c in order])
    place = [col("__first"), col("Status"), _collated(date_col), *[col(c) for c in order]]
    return spread.orderBy(*place).drop("__first")


def duplicate_groups(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date_col: str = DEFAULT_COLUMNS.date,
    order_by: Sequence[str] = ORD,
    require_date: bool = False,
    limit: int | None = None,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """Keys with more than one row, their size and number of upload times.

    ``limit`` keeps the groups that come first (a report of a few groups).
    """
    if repeated is None:
        repeated = repeated_keys(df, keys, date_col, order_by, require_date)
    groups = repeated.select(
        *[col(k) for k in keys],
        col("__n").alias("n"),
        col("__dates").alias("n_distinct_dates"),
        col("__first").alias("first_ord"),
    )
    return groups if limit is None else groups.orderBy("first_ord").limit(limit)


def cleaning_stats(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    date_col: str = DEFAULT_COLUMNS.date,
    order_by: Sequence[str] = ORD,
    require_date: bool = False,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """Rows before, groups with repeats, rows removed, rows after."""
    if repeated is None:
        repeated = repeated_keys(df, keys, date_col, order_by, require_date)
    found = repeated.agg(
        F.count(F.lit(1)).alias("groups"), F.sum(col("__n") - 1).alias("rows_removed")
    )
    # Each side is one row; stacking and folding them needs no join.
    both = df.agg(F.count(F.lit(1)).alias("rows_before")).unionByName(found, allowMissingColumns=True)
    before, removed = F.max("rows_before"), F.coalesce(F.max("rows_removed"), F.lit(0))
    return both.agg(
        before.alias("rows_before"),
        F.max("groups").alias("groups"),
        removed.alias("rows_removed"),
        (before - removed).alias("rows_after"),
    )

"""Many exports into one table without repeated responses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from rollcall.columns import DEFAULT_COLUMNS, ORD
from rollcall.operators.dedup import dedup, dedup_stats
from rollcall.operators.rows import ensure_columns, keys_first
from rollcall.operators.sets import union_all
from rollcall.session import once
from rollcall.sources.csv import CsvFormat, Loaded, read_many
from rollcall.sources.files import find_files


@dataclass(frozen=True)
class Collated:
    df: DataFrame
    stats: DataFrame
    loaded: Loaded | None = None


def collate_tables(
    frames: Sequence[DataFrame],
    keys: Sequence[str] | None,
    order_by: Sequence[str],
    keep: str = "first",
    empty_keys: str = "collapse",
) -> Collated:
    """Stack tables by column name and keep one row per key."""
    return _one_per_key(union_all(frames), keys, order_by, keep, empty_keys)


def collate(
    spark: SparkSession,
    inputs: str | Sequence[str],
    keys: Sequence[str] | None = (DEFAULT_COLUMNS.response_id,),
    keep: str = "first",
    empty_keys: str = "collapse",
    pattern: str = "*.csv",
    recursive: bool = False,
    fmt: CsvFormat = CsvFormat(),
    on_error: str = "skip",
    store: bool = True,
) -> Collated:
    """Find, read and stack CSV files, then keep one row per key.

    The stacked rows and the rows kept are stored as Parquet in the shared folder, so files are parsed once and
    keys settled once, and whatever follows reads the columns it needs. They are not bucketed by participant: one
    with a third of all rows would be one task in every later step. ``store=False`` leaves all of it to each use.
    """
    found = find_files(spark, inputs, pattern, recursive, on_error)
    loaded = read_many(spark, found.paths, fmt, on_error)
    loaded = replace(loaded, skipped={**found.skipped, **loaded.skipped})
    if store:
        loaded = replace(loaded, df=once(loaded.df))
    done = _one_per_key(loaded.df, keys, ORD, keep, empty_keys)
    return Collated(once(done.df) if store else done.df, done.stats, loaded)


def _one_per_key(
    df: DataFrame, keys: Sequence[str] | None, order_by: Sequence[str], keep: str, empty_keys: str
) -> Collated:
    if keys:
        df = keys_first(ensure_columns(df, keys), keys)
    data = keys or [c for c in df.columns if c not in order_by]
    return Collated(dedup(df, keys, order_by, keep, empty_keys), dedup_stats(df, data))

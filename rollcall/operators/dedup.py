"""One row per key, and counts of what that removes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.columns import DEFAULT_COLUMNS, FILE_ORD, ORD, col, order_names, order_parts, order_value
from rollcall.operators.rows import ensure_columns
from rollcall.operators.sets import union_rows

_RN = "__rn"


def first_per_key(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order.

    The only filter on the row number is ``= 1``, for which Spark keeps one row
    per key and task before the shuffle. A key that holds a third of all rows
    therefore sends at most one row per task to the task that settles it.
    """
    ranked = df.withColumn(_RN, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(col(_RN) == 1).drop(_RN)


def key_value(df: DataFrame, key: str) -> Column:
    """A key column, with null and ``''`` made one value where it is text."""
    if isinstance(df.schema[key].dataType, T.StringType):
        return F.coalesce(col(key), F.lit(""))
    return col(key)


def dedup(
    df: DataFrame,
    keys: Sequence[str] | None = (DEFAULT_COLUMNS.response_id,),
    order_by: Sequence[str] = ORD,
    keep: str = "first",
    empty_keys: str = "collapse",
) -> DataFrame:
    """First or last row of each key set; with no keys, of each identical row.

    ``empty_keys="collapse"`` treats rows whose keys are all empty as repeats of
    one another; ``"keep"`` keeps them all, and they skip the shuffle.
    """
    order = order_names(order_by)
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    if not keys:
        return _dedup_identical(df, order, keep)
    df = ensure_columns(df, keys)
    values = [key_value(df, k) for k in keys]
    sort = [col(c).asc() if keep == "first" else col(c).desc() for c in order]
    if empty_keys == "collapse":
        return first_per_key(df, values, sort)
    if empty_keys != "keep":
        raise ValueError(f"empty_keys must be 'collapse' or 'keep', not {empty_keys!r}")
    empty = _all_empty(df, keys)
    return union_rows(df.filter(empty), first_per_key(df.filter(~empty), values, sort))


def _all_empty(df: DataFrame, keys: Sequence[str]) -> Column:
    empty = F.lit(True)
    for k in keys:
        empty = empty & F.coalesce(key_value(df, k).cast("string") == "", F.lit(True))
    return empty


def _dedup_identical(df: DataFrame, order: Sequence[str], keep: str) -> DataFrame:
    # Rows that agree in every other column differ in their place alone, so an
    # aggregate of the place is enough and repeats merge before the shuffle.
    rest = [c for c in df.columns if c not in order]
    pick = F.min if keep == "first" else F.max
    place = pick(order_value(order)).alias("__ord")
    grouped = df.groupBy(*[key_value(df, c).alias(c) for c in rest]).agg(place)
    parts = order_parts(order, col("__ord"))
    return grouped.select(
        *[parts[c].cast(df.schema[c].dataType).alias(c) if c in parts else col(c) for c in df.columns]
    )


def dedup_stats(
    df: DataFrame, keys: Sequence[str] | None = (DEFAULT_COLUMNS.response_id,)
) -> DataFrame:
    """Rows before, removed and after ``dedup`` on these keys (all columns if none)."""
    df = ensure_columns(df, keys or ())
    per_key = df.groupBy(
        *[key_value(df, k).alias(k) for k in keys or df.columns]
    ).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n"), F.lit(0))
    after = F.count(F.lit(1))
    return per_key.agg(
        before.alias("rows_before"), (before - after).alias("rows_removed"), after.alias("rows_after")
    )


def ids_by_first_seen(
    df: DataFrame, id_col: str = DEFAULT_COLUMNS.response_id, order_by: Sequence[str] = ORD
) -> DataFrame:
    """Each id with its number of rows and its earliest place."""
    return df.groupBy(key_value(df, id_col).alias(id_col)).agg(
        F.count(F.lit(1)).alias("n"), F.min(order_value(order_names(order_by))).alias("first_ord")
    )


def sample_ids(
    df: DataFrame,
    id_col: str = DEFAULT_COLUMNS.response_id,
    n: int = 10,
    order_by: Sequence[str] = ORD,
) -> DataFrame:
    """The ``n`` distinct ids that come first."""
    seen = ids_by_first_seen(df, id_col, order_by)
    return seen.orderBy("first_ord").limit(n).select(col(id_col))


def id_stats(
    df: DataFrame,
    id_col: str = DEFAULT_COLUMNS.response_id,
    order_by: Sequence[str] = ORD,
    sample: int = 10,
) -> DataFrame:
    """One row: rows, unique ids, repeats, empty ids, and the first few ids."""
    # Both uses ask for all columns, so they are the same aggregate, made once.
    ids = ids_by_first_seen(df, id_col, order_by).filter("first_ord IS NOT NULL AND n > 0")
    total = F.coalesce(F.sum("n"), F.lit(0))
    unique = F.count(F.lit(1))
    first = ids.orderBy("first_ord").limit(sample)
    first = first.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("first_ord", col(id_col).alias("id")))),
            lambda entry: entry["id"],
        ).alias("ids")
    )
    # The names of the figures.
    return ids.agg(
        total.alias("totalRows"),
        unique.alias("uniqueResponseIds"),
        (total - unique).alias("duplicateResponseIds"),
        F.coalesce(F.sum(F.when(col(id_col) == "", F.col("n"))), F.lit(0)).alias("emptyResponseIds"),
    ).withColumn("sampleResponseIds", first.scalar())


def id_stats_by_file(
    df: DataFrame, id_col: str = DEFAULT_COLUMNS.response_id, file_col: str = FILE_ORD
) -> DataFrame:
    """Rows, unique ids and repeats per file."""
    rows, unique = F.count(F.lit(1)), F.count_distinct(key_value(df, id_col))
    return df.groupBy(col(file_col)).agg(
        rows.alias("rows"), unique.alias("unique_ids"), (rows - unique).alias("duplicate_ids")
    )

"""Views of a summary limited to the last N days and to one participant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.columns import col
from rollcall.functions.dates import is_day_text, rolled_date
from rollcall.functions.numbers import parse_days_option
from rollcall.operators.participation import PID
from rollcall.operators.rows import for_participant


def max_day(daily: DataFrame) -> DataFrame:
    """Newest well-formed day, as one row."""
    return daily.filter(is_day_text(col("day"))).agg(F.max("day").alias("day"))


def last_days(
    daily: DataFrame, n: str | int | None = "all", anchor: DataFrame | None = None
) -> DataFrame:
    """Rows of the ``n`` days that end with the newest day of the data.

    ``anchor`` gives the daily counts that set the newest day, if not the same.
    The newest day is a scalar subquery: no join, and nothing goes to the driver. Days
    of the right shape that are in no calendar run on into the next month or year.
    """
    well_formed = daily.filter(is_day_text(col("day")))
    limit = parse_days_option(n)
    if limit is None:
        return well_formed
    newest = max_day(daily if anchor is None else anchor).scalar()
    return well_formed.filter(rolled_date(col("day")) >= F.date_sub(rolled_date(newest), limit - 1))


def active_in(df: DataFrame, daily_in_range: DataFrame) -> DataFrame:
    """Rows of the participants who have an entry in range."""
    return df.join(daily_in_range.filter(col("n") > 0).select(PID), PID, "left_semi")


def summary_in_range(
    daily: DataFrame,
    totals: DataFrame,
    n: str | int | None = "all",
    anchor: DataFrame | None = None,
    entries_in_range: bool = False,
) -> DataFrame:
    """Counts in range with the totals of the whole period, in long form.

    The join drops the participants who have no entry in range. Both sides are
    aggregates with at most one row per participant and day.
    """
    in_range = last_days(daily, n, anchor).filter(col("n") > 0).select(PID, "day", "n")
    totals = totals.drop("first_ord")
    if entries_in_range:
        sums = in_range.groupBy(PID).agg(F.sum("n").alias("EntriesInRange"))
        totals = totals.join(sums, PID)
    return totals.join(in_range, PID)


def filtered_view(
    daily: DataFrame,
    totals: DataFrame,
    n: str | int | None = "all",
    pid: str | None = None,
    anchor: DataFrame | None = None,
) -> DataFrame:
    """Range filter, then participant filter."""
    return for_participant(summary_in_range(daily, totals, n, anchor), pid)

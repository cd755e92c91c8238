"""Participation figures and chart series, from the long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.columns import col
from rollcall.functions.dates import is_day_text, label_day, label_month, label_short
from rollcall.functions.numbers import round_half_up2
from rollcall.operators.participation import PID, summary_order


def participant_count(totals: DataFrame, total: str = "TotalEntries") -> DataFrame:
    return totals.agg(
        F.count(F.lit(1)).alias("participantCount"),
        F.coalesce(F.sum(total), F.lit(0)).alias("totalEntries"),
    )


def by_activity(totals: DataFrame, total: str = "TotalEntries") -> DataFrame:
    """Participants by total, greatest first; ties in summary order."""
    return totals.orderBy(F.desc(total), *summary_order(totals))


def _activity_key(totals: DataFrame, total: str) -> Column:
    """Place in ``by_activity`` as one comparable value."""
    return F.struct((-col(total)).alias("k0"), *summary_order(totals))


def _active(totals: DataFrame, pick, total: str) -> Column:
    who = F.struct(col(PID).alias("id"), col(total).alias("entries"))
    return pick(who, _activity_key(totals, total))


def top_active(totals: DataFrame, total: str = "TotalEntries") -> DataFrame:
    """First participant of ``by_activity``: an aggregate, not a sort."""
    return totals.agg(_active(totals, F.min_by, total).alias("a")).select("a.*")


def least_active(totals: DataFrame, total: str = "TotalEntries") -> DataFrame:
    """Last participant of ``by_activity``."""
    return totals.agg(_active(totals, F.max_by, total).alias("a")).select("a.*")


def _per_day(daily: DataFrame) -> DataFrame:
    counted = daily.filter(is_day_text(col("day")) & (col("n") > 0))
    return counted.groupBy("day").agg(F.count(F.lit(1)).alias("active"))


def participation_stats(daily: DataFrame, totals: DataFrame) -> DataFrame:
    """One row of figures; zeros and nulls if there are no participants."""
    people = totals.agg(
        F.count(F.lit(1)).alias("people"),
        F.sum("TotalEntries").alias("entries"),
        _active(totals, F.min_by, "TotalEntries").alias("most"),
        _active(totals, F.max_by, "TotalEntries").alias("least"),
    )
    calendar = _per_day(daily).agg(
        F.count(F.lit(1)).alias("days"), F.sum("active").alias("active_days")
    )
    # Each side is one row; stacking and folding them needs no join.
    both = people.unionByName(calendar, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("people", "entries", "days", "active_days")],
        F.first("most", ignorenulls=True).alias("most"),
        F.first("least", ignorenulls=True).alias("least"),
    )
    zero = F.lit(0)
    # The names of the figures.
    return both.select(
        F.coalesce(col("people"), zero).alias("totalParticipants"),
        _mean("entries", "people").alias("avgEntriesPerParticipant"),
        F.coalesce(col("entries"), zero).alias("totalEntries"),
        col("most").alias("mostActiveParticipant"),
        col("least").alias("leastActiveParticipant"),
        _mean("active_days", "days").alias("avgDailyParticipation"),
        F.coalesce(col("active_days"), zero).alias("totalActiveDays"),
    )


def _mean(total: str, n: str) -> Column:
    return F.when(col(n) > 0, round_half_up2(col(total) / col(n))).otherwise(F.lit(0.0))


def _labelled(series: DataFrame) -> DataFrame:
    day = col("date")
    return series.select(
        "date",
        "entries",
        label_short(day).alias("formattedDate"),
        label_day(day).alias("dayNumber"),
        label_month(day).alias("monthName"),
    ).orderBy(F.desc("date"))


def chart_daily(daily: DataFrame) -> DataFrame:
    """Entries per day over all participants, newest first."""
    counted = daily.filter(is_day_text(col("day")))
    return _labelled(counted.groupBy(col("day").alias("date")).agg(F.sum("n").alias("entries")))


def chart_participant(daily: DataFrame, pid: str) -> DataFrame:
    """Entries of one participant on every day that occurs; nothing if unknown."""
    own = col(PID) == pid
    series = (
        daily.filter(is_day_text(col("day")))
        .groupBy(col("day").alias("date"))
        .agg(F.sum(F.when(own, col("n")).otherwise(F.lit(0))).alias("entries"))
    )
    known = daily.filter(own).select(F.count(F.lit(1))).scalar() > 0
    return _labelled(series.filter(known))


def chart_scaled(chart: DataFrame) -> DataFrame:
    """Adds each day's share of the peak day; 0 where the peak is 0."""
    peak = chart.select(F.max("entries")).scalar()
    share = F.when(peak > 0, col("entries") / peak).otherwise(F.lit(0.0))
    return chart.withColumn("share", share)

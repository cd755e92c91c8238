"""Entries per participant and day.

The long form ``(ParticipantID, day, n)`` is the base of everything here; wide
tables, with days as columns, are made from it at the edge. It is aggregated
before it is shuffled, so a participant with a third of all answers is, from
there on, one row per day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.columns import (
    AUDIO_KINDS,
    DEFAULT_COLUMNS,
    END_TIME,
    SurveyColumns,
    col,
    order_names,
    order_value,
)
from rollcall.functions.dates import answer_time, day_range, event_day, incentive_time, is_day_text
from rollcall.functions.numbers import id_rank
from rollcall.operators.dedup import first_per_key
from rollcall.operators.joins import join_small
from rollcall.operators.rows import audio_rows, end_time_rows, incentive_rows
from rollcall.session import once

PID = "ParticipantID"

#: Most days that a wide table, or a page of one, may have. Only their names ever reach the driver.
MAX_DAY_COLUMNS = 10_000


def _daily(
    rows: DataFrame,
    time: Column,
    cols: SurveyColumns,
    policy: str,
    order_by: Sequence[str] | None,
    *by: Column,
    rejects: Observation | None = None,
) -> DataFrame:
    order = order_names(order_by) if order_by else []
    kept = [col(cols.kind).alias("__kind")] if rejects is not None else []
    days = rows.select(
        *by, col(cols.participant).alias(PID), event_day(time, policy).alias("day"), *[col(c) for c in order], *kept
    )
    keys = days.columns[: len(by) + 2]
    if rejects is not None:
        days = days.observe(rejects, *_reject_counts())
    counts = [F.count("day").alias("n")]
    if order:
        counts.append(F.min(order_value(order)).alias("first_ord"))
    # Rows without a day end up in groups of count 0. A filter on the day itself
    # would be pushed to the rows and work every day out twice.
    return days.groupBy(*keys).agg(*counts).filter(col("n") > 0)


def _reject_counts() -> list[Column]:
    """Per kind of row: rows read, rows without a day, rows with a day that is not well formed."""
    out = []
    for kind in (END_TIME, *AUDIO_KINDS):
        own = col("__kind") == kind
        out += [
            F.count_if(own).alias(f"rows {kind}"),
            F.count_if(own & col("day").isNull()).alias(f"without_day {kind}"),
            F.count_if(own & ~is_day_text(col("day"))).alias(f"malformed {kind}"),
        ]
    return out


def reject_table(spark: SparkSession, rejects: Observation) -> DataFrame:
    """``kind``, ``rows``, ``without_day``, ``malformed`` of a pass that has been made with the observation."""
    seen, names = rejects.get, ("rows", "without_day", "malformed")
    table = [(kind, *[seen[f"{n} {kind}"] for n in names]) for kind in (END_TIME, *AUDIO_KINDS)]
    return spark.createDataFrame(table, "kind string, rows bigint, without_day bigint, malformed bigint")


def daily_entries(
    df: DataFrame,
    cols: SurveyColumns = DEFAULT_COLUMNS,
    policy: str = "text",
    order_by: Sequence[str] | None = None,
    rejects: Observation | None = None,
) -> DataFrame:
    """``end_time`` rows per participant and day of their ``Response``.

    With ``order_by``, ``first_ord`` tells where each pair is first seen; the
    order of participants, and with it ties in the statistics, rests on it. ``rejects``
    counts what has no day on the way (see ``reject_table``).
    """
    return _daily(end_time_rows(df, cols), col(cols.response), cols, policy, order_by, rejects=rejects)


def daily_audio(
    df: DataFrame,
    cols: SurveyColumns = DEFAULT_COLUMNS,
    policy: str = "text",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Audio rows per participant and day of their answer time."""
    return _daily(audio_rows(df, cols), answer_time(cols), cols, policy, order_by)


def daily_series(
    df: DataFrame,
    cols: SurveyColumns = DEFAULT_COLUMNS,
    policy: str = "text",
    order_by: Sequence[str] | None = None,
    rejects: Observation | None = None,
) -> DataFrame:
    """Both kinds of counts from one pass over the rows, told apart by ``audio``."""
    audio = col(cols.kind).isin(*AUDIO_KINDS)
    rows = df.filter((col(cols.kind) == END_TIME) | audio)
    time = F.when(audio, answer_time(cols)).otherwise(col(cols.response))
    return _daily(rows, time, cols, policy, order_by, audio.alias("audio"), rejects=rejects)


def _totals(daily: DataFrame, total: str) -> DataFrame:
    sums = [F.sum("n").alias(total)]
    if "first_ord" in daily.columns:
        sums.append(F.min("first_ord").alias("first_ord"))
    return daily.groupBy(PID).agg(*sums)


def total_entries(daily: DataFrame) -> DataFrame:
    """Entries per participant, those with a malformed day included."""
    return _totals(daily, "TotalEntries")


def total_audio(audio_daily: DataFrame) -> DataFrame:
    return _totals(audio_daily, "TotalTextAudio")


def days(daily: DataFrame) -> DataFrame:
    """Well-formed days that occur, newest first."""
    return daily.filter(is_day_text(col("day"))).select("day").distinct().orderBy(F.desc("day"))


def day_list(daily: DataFrame, limit: int = MAX_DAY_COLUMNS) -> list[str]:
    """The same days as names for columns; an error beyond ``limit``."""
    names = [row.day for row in days(daily).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} days: use pages of columns, or the long form")
    return names


def day_pages(daily: DataFrame, size: int = MAX_DAY_COLUMNS) -> Iterator[list[str]]:
    """The same days in pages of ``size`` names, newest first; one empty page if there are none."""
    page: list[str] = []
    for row in days(daily).toLocalIterator():
        if len(page) == size:
            yield page
            page = []
        page.append(row.day)
    yield page


def latest_incentive(
    df: DataFrame, order_by: Sequence[str], cols: SurveyColumns = DEFAULT_COLUMNS
) -> DataFrame:
    """Incentive with the greatest answer time per participant; ties keep the first row."""
    order = order_names(order_by)
    rows = incentive_rows(df, cols).select(
        col(cols.participant).alias(PID),
        col(cols.response).alias("Incentive"),
        incentive_time(cols).alias("__time"),
        *[col(c) for c in order],
    )
    newest = first_per_key(rows, [col(PID)], [col("__time").desc(), *[col(c).asc() for c in order]])
    return newest.select(PID, "Incentive")


def with_incentive(totals: DataFrame, incentive: DataFrame) -> DataFrame:
    return totals.join(incentive, PID, "left")


def _cells(daily: DataFrame, day_names: Sequence[str], total: str | None = None) -> DataFrame:
    """One row per participant: its total, if named, and a count per day or null.

    Rows move to their participant while still narrow. A pivot straight on the
    (participant, day) partitioning would shuffle one all-days-wide row per pair.
    The total is a window over the same partitioning, at most one row per day.
    """
    keys = [PID]
    moved = daily.repartition(col(PID))
    if total is not None:
        own = Window.partitionBy(PID)
        sums = {total: F.sum("n").over(own)}
        if "first_ord" in daily.columns:
            sums["first_ord"] = F.min("first_ord").over(own)
        moved, keys = moved.withColumns(sums), [PID, *sums]
    if not day_names:
        return moved.select(*keys).distinct()
    cells = moved.groupBy(*keys).pivot("day", list(day_names)).agg(F.sum("n"))
    return cells.na.fill(0, list(day_names))


def _wide(
    daily: DataFrame, totals: DataFrame | None, day_names: Sequence[str], total: str
) -> DataFrame:
    """Totals with a count per day; totals not given are those of the counts."""
    if totals is None:
        return _cells(daily, day_names, total)
    joined = totals.join(_cells(daily, day_names), PID, "left")
    return joined.na.fill(0, list(day_names)) if day_names else joined


def zero_fill(
    totals: DataFrame | None, daily: DataFrame, day_names: Sequence[str] | DataFrame
) -> DataFrame:
    """Every participant with every day: the count, or 0.

    ``totals`` names the participants, if they are not just those of the counts. Days given as names
    are columns of one row per participant, which is unpivoted inside its task. Days given as a
    frame (``day``) are never named on the driver, and there may be any number of them.
    """
    people = None if totals is None else totals.select(PID)
    if isinstance(day_names, DataFrame):
        return _fill(daily.select(PID).distinct() if people is None else people.distinct(), daily, day_names)
    wide = _wide(daily, people, day_names, "total")
    if not day_names:
        return wide.select(PID, F.lit("").alias("day"), F.lit(0).cast("bigint").alias("n")).limit(0)
    return wide.unpivot([col(PID)], [col(d) for d in day_names], "day", "n")


def _fill(people: DataFrame, daily: DataFrame, days: DataFrame) -> DataFrame:
    """Zeros between the counts of each participant, by the places of days in the calendar.

    Each count makes the zeros up to the participant's next one, and a mark ahead of all counts makes those before
    the first; so a participant is sorted once, as one row per count, and nothing is joined to make zeros.
    """
    newest_first = Window.orderBy(F.desc("day"))  # a calendar: one row per day
    calendar = once(days.select("day").distinct().select("day", (F.row_number().over(newest_first) - 1).alias("at")))
    end = calendar.agg(F.count(F.lit(1)).cast("int")).scalar()
    counts = join_small(daily.select(PID, "day", "n"), calendar, ["day"]).select(PID, "at", "n")
    marks = people.select(PID, F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("n"))
    own = Window.partitionBy(PID).orderBy("at")
    rows = counts.unionByName(marks).withColumns(
        {"known": F.first("at").over(own) == -1, "until": F.lead("at").over(own)}
    )
    start, last = F.greatest(col("at"), F.lit(0)), F.coalesce(col("until"), end) - 1
    places = F.when(start <= last, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))
    filled = rows.filter("known").select(PID, col("at").alias("of"), "n", F.explode(places).alias("at"))
    filled = filled.select(PID, "at", F.when(col("at") == col("of"), col("n")).otherwise(F.lit(0)).alias("n"))
    return join_small(filled, calendar, ["at"]).select(PID, "day", "n")


def summary_order(totals: DataFrame) -> list[Column]:
    """Sort key of participants: whole-number ids by value, then others as first seen."""
    last = [col("first_ord")] if "first_ord" in totals.columns else []
    return [id_rank(col(PID)), *last, col(PID)]


def _finish(wide: DataFrame, sort: bool) -> DataFrame:
    ordered = wide.orderBy(*summary_order(wide)) if sort else wide
    return ordered.drop("first_ord")


def summary_wide(
    daily: DataFrame,
    totals: DataFrame | None,
    incentive: DataFrame | None,
    day_names: Sequence[str],
    sort: bool = False,
) -> DataFrame:
    """Participant, total, latest incentive, then a count per day.

    Give ``totals`` to report other participants or totals than those of the
    counts; without them one pass over the counts yields everything.
    """
    wide = _wide(daily, totals, day_names, "TotalEntries")
    if incentive is None:
        wide = wide.withColumn("Incentive", F.lit(None).cast("string"))
    else:
        wide = with_incentive(wide, incentive)
    head = [PID, "TotalEntries", "Incentive"]
    rest = [c for c in wide.columns if c not in head]
    return _finish(wide.select(*head, *[col(c) for c in rest]), sort)


def summary_pages(
    daily: DataFrame, incentive: DataFrame | None, size: int = MAX_DAY_COLUMNS, sort: bool = False
) -> list[DataFrame]:
    """The summary in pages of at most ``size`` days, for any number of days.

    Every page holds all participants in the same order; the first also has totals and incentives. Laid side by side
    they are the summary, but no row of so many columns is ever made.
    """
    pages = []
    for names in day_pages(daily, size):
        page = summary_wide(daily, None, None if pages else incentive, names, sort)
        pages.append(page.drop("TotalEntries", "Incentive") if pages else page)
    return pages


def audio_wide(
    audio_daily: DataFrame,
    audio_totals: DataFrame | None,
    day_names: Sequence[str],
    sort: bool = False,
) -> DataFrame:
    """Audio twin; its day columns are the days of the ``end_time`` entries."""
    return _finish(_wide(audio_daily, audio_totals, day_names, "TotalTextAudio"), sort)


def summary_30day(
    df: DataFrame,
    anchor: dt.date | str,
    cols: SurveyColumns = DEFAULT_COLUMNS,
    order_by: Sequence[str] | None = None,
    n: int = 30,
) -> DataFrame:
    """Totals over all time with a count for each of the 30 days ending at the anchor."""
    daily = daily_entries(df, cols, "utc", order_by)
    return _finish(_wide(daily, None, day_range(anchor, n), "TotalEntries"), bool(order_by))


def audio_30day(
    df: DataFrame,
    anchor: dt.date | str,
    cols: SurveyColumns = DEFAULT_COLUMNS,
    order_by: Sequence[str] | None = None,
    n: int = 30,
) -> DataFrame:
    daily = daily_audio(df, cols, "utc", order_by)
    return _finish(_wide(daily, None, day_range(anchor, n), "TotalTextAudio"), bool(order_by))

"""Entries per participant and day, and what is made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.catalog.registry import query
from rollcall.catalog.survey_view import (
    AUDIO_DAILY,
    AUDIO_TOTALS,
    DAILY,
    INCENTIVE,
    ORDER,
    SURVEY,
    TOTALS,
    day_sums,
    survey,
    table,
    with_,
)
from rollcall.columns import SurveyColumns
from rollcall.operators import participation as p
from rollcall.operators import ranges, stats
from rollcall.operators import rows as r
from rollcall.operators.sets import union_rows
from rollcall.plans.participation import Participation

BASE = with_(SURVEY, DAILY, TOTALS)
AUDIO = with_(SURVEY, DAILY, AUDIO_DAILY, AUDIO_TOTALS)


def _analysis(spark, sf_dir, with_audio: bool = False) -> Participation:
    return Participation(survey(spark, sf_dir), order_by=ORDER, with_audio=with_audio)


def _daily(spark, sf_dir) -> DataFrame:
    return p.daily_entries(survey(spark, sf_dir))


def _audio_daily(spark, sf_dir) -> DataFrame:
    return p.daily_audio(survey(spark, sf_dir))


@query(with_(SURVEY) + "SELECT * FROM survey WHERE QuestionsType = 'end_time'")
def flt_end_time(spark, sf_dir):
    return r.end_time_rows(survey(spark, sf_dir))


@query(with_(SURVEY) + "SELECT * FROM survey WHERE QuestionsType = 'Incentives' AND Response <> ''")
def flt_incentives(spark, sf_dir):
    return r.incentive_rows(survey(spark, sf_dir))


@query(with_(SURVEY) + "SELECT * FROM survey WHERE QuestionsType IN ('textaudio', 'audio')")
def flt_audio(spark, sf_dir):
    return r.audio_rows(survey(spark, sf_dir))


@query(BASE + "SELECT ParticipantID, day, n FROM daily")
def agg_daily_entries(spark, sf_dir):
    return _daily(spark, sf_dir)


@query(BASE + "SELECT ParticipantID, TotalEntries FROM totals")
def agg_total_entries(spark, sf_dir):
    return p.total_entries(_daily(spark, sf_dir))


@query(AUDIO + "SELECT ParticipantID, day, n FROM audio_daily")
def agg_daily_audio(spark, sf_dir):
    return _audio_daily(spark, sf_dir)


@query(AUDIO + "SELECT ParticipantID, TotalTextAudio FROM audio_totals")
def agg_total_audio(spark, sf_dir):
    return p.total_audio(_audio_daily(spark, sf_dir))


@query(BASE + "SELECT DISTINCT day FROM daily ORDER BY day DESC")
def agg_days(spark, sf_dir):
    return p.days(_daily(spark, sf_dir))


@query(AUDIO + "SELECT day, row_number() OVER (ORDER BY day DESC) - 1 AS position FROM (SELECT DISTINCT day FROM audio_daily)")
def ord_days_desc(spark, sf_dir):
    return r.numbered(p.days(_audio_daily(spark, sf_dir)))


@query(with_(SURVEY, INCENTIVE) + "SELECT * FROM incentive")
def agg_latest_incentive(spark, sf_dir):
    return p.latest_incentive(survey(spark, sf_dir), ORDER)


@query(
    with_(SURVEY, DAILY, TOTALS, INCENTIVE)
    + "SELECT ParticipantID, TotalEntries, Incentive FROM totals LEFT JOIN incentive USING (ParticipantID)"
)
def join_incentive(spark, sf_dir):
    df = survey(spark, sf_dir)
    totals = p.total_entries(p.daily_entries(df))
    return p.with_incentive(totals, p.latest_incentive(df, ORDER))


@query(
    BASE
    + "SELECT t.ParticipantID, d.day, coalesce(daily.n, 0) AS n FROM totals t"
    " CROSS JOIN (SELECT DISTINCT day FROM daily) d"
    " LEFT JOIN daily ON daily.ParticipantID = t.ParticipantID AND daily.day = d.day"
)
def join_zero_fill(spark, sf_dir):
    done = _analysis(spark, sf_dir)
    return done.zero_filled()


@query(
    AUDIO
    + "SELECT t.ParticipantID, d.day, coalesce(a.n, 0) AS n FROM audio_totals t"
    " CROSS JOIN (SELECT DISTINCT day FROM daily) d"
    " LEFT JOIN audio_daily a ON a.ParticipantID = t.ParticipantID AND a.day = d.day"
)
def join_zero_fill_audio(spark, sf_dir):
    done = _analysis(spark, sf_dir, with_audio=True)
    return p.zero_fill(None, done.audio_daily, p.days(done.daily))


SUMMARY = (
    with_(SURVEY, DAILY, TOTALS, INCENTIVE)
    + "SELECT ParticipantID, any_value(TotalEntries) AS TotalEntries, any_value(Incentive) AS Incentive, "
    + day_sums()
    + " FROM totals LEFT JOIN incentive USING (ParticipantID) LEFT JOIN daily USING (ParticipantID)"
    " GROUP BY ParticipantID"
)


@query(SUMMARY)
def agg_summary_wide(spark, sf_dir):
    return _analysis(spark, sf_dir).summary()


AUDIO_WIDE = (
    AUDIO
    + "SELECT ParticipantID, any_value(TotalTextAudio) AS TotalTextAudio, "
    + day_sums()
    + " FROM audio_totals JOIN audio_daily USING (ParticipantID) GROUP BY ParticipantID"
)


@query(AUDIO_WIDE)
def agg_audio_wide(spark, sf_dir):
    return _analysis(spark, sf_dir, with_audio=True).audio()


# Thirty days that end ten days before the data do and begin before them.
ANCHOR_INSIDE = "2024-01-20"
DAYS_INSIDE = p.day_range(ANCHOR_INSIDE)


@query(
    BASE
    + "SELECT ParticipantID, any_value(TotalEntries) AS TotalEntries, "
    + day_sums(DAYS_INSIDE)
    + " FROM totals JOIN daily USING (ParticipantID) GROUP BY ParticipantID"
)
def agg_30day(spark, sf_dir):
    return p.summary_30day(survey(spark, sf_dir), ANCHOR_INSIDE)


@query(
    AUDIO
    + "SELECT ParticipantID, any_value(TotalTextAudio) AS TotalTextAudio, "
    + day_sums(DAYS_INSIDE)
    + " FROM audio_totals JOIN audio_daily USING (ParticipantID) GROUP BY ParticipantID"
)
def agg_30day_audio(spark, sf_dir):
    return p.audio_30day(survey(spark, sf_dir), ANCHOR_INSIDE)


@query(SUMMARY)
def agg_summary_pages(spark, sf_dir):
    """The summary in pages of seven days, joined back by participant."""
    first, *others = _analysis(spark, sf_dir).summary_pages(7)
    for page in others:
        first = first.join(page, "ParticipantID")
    return first


@query(
    BASE
    + "SELECT count(*) AS participantCount, CAST(coalesce(sum(TotalEntries), 0) AS BIGINT) AS totalEntries FROM totals"
)
def agg_participant_count(spark, sf_dir):
    return stats.participant_count(p.total_entries(_daily(spark, sf_dir)))


# Every id here is a whole number, so the order of participants is that of its value.
ACTIVITY = "TotalEntries DESC, CAST(ParticipantID AS BIGINT)"
ACTIVITY_LAST = "TotalEntries, CAST(ParticipantID AS BIGINT) DESC"


@query(
    BASE
    + f"""SELECT count(*) AS totalParticipants,
  floor(CAST(sum(TotalEntries) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS avgEntriesPerParticipant,
  CAST(sum(TotalEntries) AS BIGINT) AS totalEntries,
  (SELECT ParticipantID FROM totals ORDER BY {ACTIVITY} LIMIT 1) AS most_id,
  max(TotalEntries) AS most_entries,
  (SELECT ParticipantID FROM totals ORDER BY {ACTIVITY_LAST} LIMIT 1) AS least_id,
  min(TotalEntries) AS least_entries,
  (SELECT floor(CAST(count(*) AS DOUBLE) / count(DISTINCT day) * 100 + 0.5) / 100 FROM daily) AS avgDailyParticipation,
  (SELECT count(*) FROM daily) AS totalActiveDays
FROM totals"""
)
def stats_participation(spark, sf_dir):
    figures = _analysis(spark, sf_dir).stats()
    most, least = F.col("mostActiveParticipant"), F.col("leastActiveParticipant")
    return figures.select(
        "totalParticipants",
        "avgEntriesPerParticipant",
        "totalEntries",
        most["id"].alias("most_id"),
        most["entries"].alias("most_entries"),
        least["id"].alias("least_id"),
        least["entries"].alias("least_entries"),
        "avgDailyParticipation",
        "totalActiveDays",
    )


@query(BASE + f"SELECT ParticipantID AS id, TotalEntries AS entries FROM totals ORDER BY {ACTIVITY} LIMIT 1")
def top_active(spark, sf_dir):
    return stats.top_active(_analysis(spark, sf_dir).totals)


@query(BASE + f"SELECT ParticipantID AS id, TotalEntries AS entries FROM totals ORDER BY {ACTIVITY_LAST} LIMIT 1")
def least_active(spark, sf_dir):
    return stats.least_active(_analysis(spark, sf_dir).totals)


@query(BASE + f"SELECT *, row_number() OVER (ORDER BY {ACTIVITY}) - 1 AS position FROM totals")
def ord_activity_desc(spark, sf_dir):
    return r.numbered(stats.by_activity(_analysis(spark, sf_dir).totals))


@query(BASE + "SELECT *, row_number() OVER (ORDER BY CAST(ParticipantID AS BIGINT)) - 1 AS position FROM totals")
def ord_summary(spark, sf_dir):
    totals = _analysis(spark, sf_dir).totals
    return r.numbered(totals.orderBy(*p.summary_order(totals)))


CHART = """
chart AS (
  SELECT day AS date, CAST(sum({n}) AS BIGINT) AS entries,
    strftime(CAST(day AS DATE), '%b %-d') AS formattedDate,
    CAST(day(CAST(day AS DATE)) AS INTEGER) AS dayNumber,
    strftime(CAST(day AS DATE), '%b') AS monthName
  FROM daily GROUP BY day)"""


@query(with_(SURVEY, DAILY, CHART.format(n="n")) + "SELECT * FROM chart")
def chart_daily(spark, sf_dir):
    return stats.chart_daily(_daily(spark, sf_dir))


@query(
    with_(SURVEY, DAILY, CHART.format(n="CASE WHEN ParticipantID = '7' THEN n ELSE 0 END"))
    + "SELECT * FROM chart"
)
def chart_participant(spark, sf_dir):
    return _analysis(spark, sf_dir).chart("7")


@query(
    with_(SURVEY, DAILY, CHART.format(n="n"))
    + "SELECT *, entries / CAST((SELECT max(entries) FROM chart) AS DOUBLE) AS share FROM chart"
)
def chart_scaled(spark, sf_dir):
    return stats.chart_scaled(stats.chart_daily(_daily(spark, sf_dir)))


def _since(n: int) -> str:
    return f"day >= strftime((SELECT max(CAST(day AS DATE)) FROM daily) - {n - 1}, '%Y-%m-%d')"


@query(BASE + "SELECT max(day) AS day FROM daily")
def win_max_day(spark, sf_dir):
    return ranges.max_day(_daily(spark, sf_dir))


@query(BASE + f"SELECT ParticipantID, day, n FROM daily WHERE {_since(7)}")
def flt_last_days(spark, sf_dir):
    return ranges.last_days(_analysis(spark, sf_dir).daily, 7).select("ParticipantID", "day", "n")


OPTIONS = {"7days": 7, " 3 days": 3, "1": 1, "all": None, "0": None, "few": None}


@query(
    BASE
    + " UNION ALL ".join(
        f"SELECT '{option}' AS option, count(*) AS rows, CAST(sum(n) AS BIGINT) AS entries FROM daily" + (f" WHERE {_since(n)}" if n else "")
        for option, n in OPTIONS.items()
    )
)
def parse_days_option(spark, sf_dir):
    """Entries in range for each way to say how many days."""
    daily = _analysis(spark, sf_dir).daily
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("n").alias("entries")]
    parts = [ranges.last_days(daily, o).agg(*sums).select(F.lit(o).alias("option"), "rows", "entries") for o in OPTIONS]
    return union_rows(*parts)


@query(BASE + f"SELECT ParticipantID, TotalEntries, day, n FROM totals JOIN daily USING (ParticipantID) WHERE {_since(7)}")
def flt_summary_range(spark, sf_dir):
    done = _analysis(spark, sf_dir)
    return ranges.summary_in_range(done.daily, done.totals, 7)


@query(
    AUDIO
    + "SELECT ParticipantID, TotalTextAudio, day, n FROM audio_totals JOIN audio_daily USING (ParticipantID)"
    f" WHERE {_since(7)} AND day IN (SELECT day FROM daily)"
)
def flt_audio_range(spark, sf_dir):
    return _analysis(spark, sf_dir, with_audio=True).audio_view(7)


@query(
    with_(SURVEY, DAILY, TOTALS, INCENTIVE)
    + "SELECT ParticipantID, TotalEntries, Incentive, day, n FROM totals"
    " LEFT JOIN incentive USING (ParticipantID) JOIN daily USING (ParticipantID)"
    f" WHERE {_since(7)} AND ParticipantID = '7'"
)
def flt_range_and_participant(spark, sf_dir):
    return _analysis(spark, sf_dir).view(7, "7")


@query(BASE + "SELECT ParticipantID, day, n FROM daily WHERE ParticipantID = '7'")
def flt_participant(spark, sf_dir):
    return r.for_participant(_daily(spark, sf_dir), "7")


@query(
    BASE
    + "SELECT ParticipantID, TotalEntries FROM totals WHERE ParticipantID IN"
    f" (SELECT ParticipantID FROM daily WHERE {_since(1)})"
)
def semi_active(spark, sf_dir):
    done = _analysis(spark, sf_dir)
    return ranges.active_in(done.totals.drop("first_ord"), ranges.last_days(done.daily, 1))


@query(
    BASE
    + "SELECT t.ParticipantID, d.day, coalesce(daily.n, 0) AS n FROM totals t"
    " CROSS JOIN (SELECT DISTINCT day FROM daily) d"
    " LEFT JOIN daily ON daily.ParticipantID = t.ParticipantID AND daily.day = d.day"
)
def prj_date_columns(spark, sf_dir):
    return r.unpivot_days(_analysis(spark, sf_dir).summary(), ["ParticipantID"])


@query(
    BASE
    + "SELECT ParticipantID, any_value(TotalEntries) AS TotalEntries, "
    + day_sums()
    + " FROM totals JOIN daily USING (ParticipantID) GROUP BY ParticipantID"
)
def prj_report_columns(spark, sf_dir):
    return r.report_columns(_analysis(spark, sf_dir).summary())


@query(
    "SELECT CAST(o_custkey AS VARCHAR) AS ParticipantID, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n"
    " FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2"
)
def src_table(spark, sf_dir):
    """Orders as entries of their customers: any table serves under other column names."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("who"),
        F.when(F.col("o_orderstatus") == "F", "end_time").otherwise("open").alias("what"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("answer"),
    )
    return p.daily_entries(orders, SurveyColumns(participant="who", kind="what", response="answer"))

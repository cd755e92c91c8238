"""The driver's tables seen as survey tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Row kind that stands for each event type; all others are 'other'.
KIND_OF_EVENT = {
    "view": "end_time",
    "purchase": "Incentives",
    "click": "textaudio",
    "signup": "audio",
}

ORDER = ["_row_ord"]
ANCHOR = "2024-01-30"
DAYS = [f"2024-01-{d:02d}" for d in range(30, 0, -1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a survey: users answer prompts, ids repeat within a day."""
    kind, iso = F.col("event_type"), F.col("iso")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    kinds = F.lit("other")
    for event, name in reversed(KIND_OF_EVENT.items()):
        kinds = F.when(kind == event, name).otherwise(kinds)
    user = F.col("user_id").cast("string")
    events = table(spark, sf_dir, "events").withColumn(
        "iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    return events.select(
        F.col("event_id").alias("_row_ord"),
        F.concat(user, F.lit("-"), F.replace(F.left(iso, F.lit(10)), F.lit("-"), F.lit(""))).alias("ResponseID"),
        user.alias("ParticipantID"),
        kind.alias("PromptID"),
        kinds.alias("QuestionsType"),
        F.when(kind == "view", iso).when(kind == "purchase", cents).otherwise("").alias("Response"),
        F.concat(F.left(iso, F.lit(13)), F.lit(":00:00")).alias("RespondedAt"),
        iso.alias("Date"),
    )


SURVEY = """
survey AS (
  SELECT event_id AS _row_ord,
    CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS ResponseID,
    CAST(user_id AS VARCHAR) AS ParticipantID,
    event_type AS PromptID,
    CASE event_type WHEN 'view' THEN 'end_time' WHEN 'purchase' THEN 'Incentives'
      WHEN 'click' THEN 'textaudio' WHEN 'signup' THEN 'audio' ELSE 'other' END AS QuestionsType,
    CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
      WHEN 'purchase' THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) ELSE '' END AS Response,
    strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS RespondedAt,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS Date
  FROM events)"""

DAILY = """
daily AS (
  SELECT ParticipantID, split_part(Response, 'T', 1) AS day, count(*) AS n, min(_row_ord) AS first_ord
  FROM survey WHERE QuestionsType = 'end_time' GROUP BY 1, 2)"""

TOTALS = """
totals AS (
  SELECT ParticipantID, CAST(sum(n) AS BIGINT) AS TotalEntries, min(first_ord) AS first_ord
  FROM daily GROUP BY 1)"""

AUDIO_DAILY = """
audio_daily AS (
  SELECT ParticipantID, split_part(RespondedAt, 'T', 1) AS day, count(*) AS n, min(_row_ord) AS first_ord
  FROM survey WHERE QuestionsType IN ('textaudio', 'audio') GROUP BY 1, 2)"""

AUDIO_TOTALS = """
audio_totals AS (
  SELECT ParticipantID, CAST(sum(n) AS BIGINT) AS TotalTextAudio, min(first_ord) AS first_ord
  FROM audio_daily GROUP BY 1)"""

INCENTIVE = """
incentive AS (
  SELECT ParticipantID, Response AS Incentive FROM (
    SELECT *, row_number() OVER (PARTITION BY ParticipantID ORDER BY RespondedAt DESC, _row_ord) AS rn
    FROM survey WHERE QuestionsType = 'Incentives' AND Response <> '') WHERE rn = 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def day_sums(days: list[str] = DAYS) -> str:
    """Select list with one count column per day."""
    return ", ".join(
        f"CAST(coalesce(sum(CASE WHEN day = '{d}' THEN n END), 0) AS BIGINT) AS \"{d}\"" for d in days
    )

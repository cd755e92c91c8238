"""Upload repeats and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.catalog.registry import query
from rollcall.catalog.survey_view import ORDER, SURVEY, survey, table, with_
from rollcall.columns import norm_header_text, rename_resolved, require_columns
from rollcall.functions.text import has_blank_key
from rollcall.operators import cleaning as c
from rollcall.operators import rows as r
from rollcall.operators.joins import join_small
from rollcall.session import once

KEYS = "PromptID, ParticipantID, RespondedAt"
MARKED = f"""
marked AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY Date, _row_ord) AS rn,
    count(*) OVER (PARTITION BY {KEYS}) AS n,
    min(_row_ord) OVER (PARTITION BY {KEYS}) AS first_ord
  FROM survey)"""
GROUPS = f"""
groups AS (
  SELECT {KEYS}, count(*) AS n, count(DISTINCT Date) AS n_distinct_dates, min(_row_ord) AS first_ord
  FROM survey GROUP BY ALL HAVING count(*) > 1)"""


@query(with_(SURVEY, MARKED) + "SELECT * EXCLUDE (rn, n, first_ord) FROM marked WHERE rn = 1")
def clean_keep_earliest(spark, sf_dir):
    return c.clean(survey(spark, sf_dir), order_by=ORDER)


@query(
    with_(SURVEY)
    + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY Response, ParticipantID, RespondedAt ORDER BY Date, _row_ord) AS rn
  FROM survey)
SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1 OR Response = ''""".lstrip("\n")
)
def clean_blank_keys(spark, sf_dir):
    keys = ("Response", "ParticipantID", "RespondedAt")
    return c.clean(survey(spark, sf_dir), keys, order_by=ORDER)


@query(with_(SURVEY, MARKED) + "SELECT * EXCLUDE (rn, n, first_ord) FROM marked WHERE rn > 1")
def clean_removed(spark, sf_dir):
    return c.clean_removed(survey(spark, sf_dir), order_by=ORDER)


@query(
    with_(SURVEY, MARKED)
    + "SELECT * FROM survey WHERE NOT EXISTS"
    " (SELECT 1 FROM marked WHERE rn > 1 AND marked._row_ord = survey._row_ord)"
)
def anti_removed(spark, sf_dir):
    """The survey without the rows that cleaning lists as removed."""
    df = survey(spark, sf_dir)
    removed = c.clean_removed(df, order_by=ORDER).select(*ORDER)
    return join_small(df, once(removed), ORDER, "left_anti").select(*df.columns)


@query(
    with_(SURVEY, MARKED)
    + "SELECT CASE WHEN rn = 1 THEN 'Kept (earliest)' ELSE 'Removed' END AS Status,"
    " * EXCLUDE (rn, n, first_ord) FROM marked WHERE n > 1"
)
def clean_review(spark, sf_dir):
    return c.clean_review(survey(spark, sf_dir), order_by=ORDER)


@query(with_(SURVEY, GROUPS) + "SELECT * FROM groups")
def agg_duplicate_groups(spark, sf_dir):
    return c.duplicate_groups(survey(spark, sf_dir), order_by=ORDER)


@query(with_(SURVEY, GROUPS) + "SELECT * FROM groups ORDER BY first_ord LIMIT 10")
def lim_groups(spark, sf_dir):
    return c.duplicate_groups(survey(spark, sf_dir), order_by=ORDER, limit=10)


@query(
    with_(SURVEY, MARKED)
    + "SELECT count(*) AS rows_before,"
    " (SELECT count(*) FROM marked WHERE n > 1 AND rn = 1) AS groups,"
    " count(*) FILTER (rn > 1) AS rows_removed, count(*) FILTER (rn = 1) AS rows_after FROM marked"
)
def stats_cleaning(spark, sf_dir):
    return c.cleaning_stats(survey(spark, sf_dir), order_by=ORDER)


@query(with_(SURVEY, MARKED) + "SELECT * EXCLUDE (rn, n, first_ord) FROM marked WHERE rn = 1")
def prj_resolve_columns(spark, sf_dir):
    uploaded = survey(spark, sf_dir).withColumnsRenamed(
        {"PromptID": " Prompt_ID", "ParticipantID": "participant id", "Date": "DATE"}
    )
    return c.clean(rename_resolved(uploaded), order_by=ORDER)


@query(
    with_(SURVEY)
    + "SELECT ParticipantID, count(*) AS rows, 'missing columns: Wave' AS refused FROM survey GROUP BY 1"
)
def chk_required_columns(spark, sf_dir):
    """Rows of a survey that has what is required, and what is said of one that has not."""
    df = require_columns(survey(spark, sf_dir), c.KEYS)
    try:
        require_columns(df, [*c.KEYS, "Wave"])
        refused = ""
    except ValueError as error:
        refused = str(error)
    return df.groupBy("ParticipantID").agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(refused))


@query(
    "SELECT doc_id, regexp_replace(lower(source), '[-_ ]', '', 'g') || replace(lang, '-', '') || 'id' AS header FROM documents"
)
def norm_header(spark, sf_dir):
    """Headers made from each document's source and language, loosely written."""
    header = F.concat(F.lit("\ufeff \t"), F.upper("source"), F.lit("_ "), F.col("lang"), F.lit("- Id\u00a0"))
    return table(spark, sf_dir, "documents").select("doc_id", norm_header_text(header).alias("header"))


@query(with_(SURVEY) + "SELECT * FROM survey WHERE lower(trim(Response)) IN ('', 'none', 'null', 'undefined')")
def flt_blank_key(spark, sf_dir):
    df = survey(spark, sf_dir)
    return df.filter(has_blank_key([F.col("Response"), F.col("PromptID")]))


def _talk(spark, sf_dir):
    """Conversations as a survey in which the user turns carry a reference."""
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("Date"),
        F.when(F.col("role") == "user", text).otherwise("").alias("Reference"),
        text.alias("Transcript"),
    )


TRANSCRIPTS = (
    "SELECT 'turn ' || CAST(turn AS VARCHAR) AS Date, text AS Reference, coalesce(text, '') AS Transcript"
    " FROM conversations WHERE role = 'user' AND length(trim(text)) > 0"
)


@query(TRANSCRIPTS)
def transcripts(spark, sf_dir):
    return r.transcripts(_talk(spark, sf_dir))


@query(
    "SELECT conv_id, turn, 'turn ' || CAST(turn AS VARCHAR) AS Date, text AS Reference, text AS Transcript"
    " FROM conversations WHERE role = 'user' AND length(trim(text)) > 0"
)
def flt_reference(spark, sf_dir):
    return r.with_reference(_talk(spark, sf_dir))


@query("SELECT 'turn ' || CAST(turn AS VARCHAR) AS Date, '' AS Reference, '' AS Transcript FROM conversations")
def prj_transcript(spark, sf_dir):
    only_date = _talk(spark, sf_dir).select("Date")
    return r.select_or_empty(only_date, ["Date", "Reference", "Transcript"])

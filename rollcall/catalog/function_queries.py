"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.catalog.registry import query
from rollcall.catalog.survey_view import DAILY, ORDER, SURVEY, survey, table, with_
from rollcall.functions import dates, numbers, text
from rollcall.operators import ranges
from rollcall.operators import rows as r
from rollcall.plans.participation import Participation
from rollcall.sources.typed_json import first_tag_value, flatten_typed_json

# The same blanks as rollcall.functions.text.BLANK_CHARS, by code point.
BLANKS = " || ".join(f"chr({ord(c)})" for c in text.BLANK_CHARS)


def _survey_expr(sql: str) -> str:
    return with_(SURVEY) + f"SELECT _row_ord, {sql} FROM survey"


@query(_survey_expr("strftime(CAST(Date AS TIMESTAMP), '%Y-%m-%d') AS day"))
def event_day_text(spark, sf_dir):
    return survey(spark, sf_dir).select("_row_ord", dates.event_day(F.col("Date")).alias("day"))


@query(_survey_expr("strftime(CAST(RespondedAt AS TIMESTAMP), '%Y-%m-%d') AS day"))
def event_day_utc(spark, sf_dir):
    return survey(spark, sf_dir).select("_row_ord", dates.event_day(F.col("RespondedAt"), "utc").alias("day"))


# Ways to write a day, and how many days later it is in UTC.
WRITTEN = [
    ("yyyy-MM-dd", "", 0),
    ("M/d/yyyy", "", 0),
    ("MMM d, yyyy", "", 0),
    ("d MMM yyyy", "", 0),
    ("MMMM d, yyyy", "", 0),
    ("M/d/yyyy", ", 11:05:00 PM", 0),
    ("M/d/yyyy", " 3:05 PM", 0),
    ("yyyy/MM/dd", "", 0),
    ("d MMMM yyyy", "", 0),
    ("M-d-yyyy", " 23:59", 0),
    ("EEE, d MMM yyyy", " 10:00:00 GMT", 0),
    ("EEE MMM dd yyyy", " 00:30:00 GMT+0200 (CEST)", -1),
    ("EEE MMM dd yyyy", " 23:30:00 GMT-0130 (NDT)", 1),
    ("yyyy-MM-dd", "T23:30:00-03:00", 1),
]


@query(
    "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CASE o_orderkey % 14"
    " WHEN 11 THEN -1 WHEN 12 THEN 1 WHEN 13 THEN 1 ELSE 0 END, '%Y-%m-%d') AS day FROM orders"
)
def event_day_free_form(spark, sf_dir):
    """Order dates written in as many ways as browsers do, by order key, and read back in UTC."""
    day = F.col("o_orderdate")
    written = [F.concat(F.date_format(day, pattern), F.lit(time)) for pattern, time, _ in WRITTEN]
    which = (F.col("o_orderkey") % len(written) + 1).cast("int")
    shown = F.element_at(F.array(*written), which)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.event_day(shown, "utc").alias("day"))


HARMED = """
harmed AS (
  SELECT QuestionsType AS kind, CASE WHEN _row_ord % 7 = 0 THEN NULL WHEN _row_ord % 7 = 1 THEN 'x' ELSE 'day' END AS day
  FROM survey WHERE QuestionsType IN ('end_time', 'textaudio', 'audio'))"""


@query(
    with_(SURVEY, HARMED)
    + "SELECT kind, count(*) AS rows, count(*) FILTER (day IS NULL) AS without_day,"
    " count(*) FILTER (day = 'x') AS malformed FROM harmed GROUP BY kind"
)
def stats_rejects(spark, sf_dir):
    """Every seventh time cannot be read, and every seventh is a day of odd shape; both are counted by the one pass."""
    df = survey(spark, sf_dir)
    for name in ("Response", "RespondedAt"):
        odd = F.when(F.col("_row_ord") % 7 == 0, "soon").when(F.col("_row_ord") % 7 == 1, "2024-1-5T08:00").otherwise(F.col(name))
        df = df.withColumn(name, odd)
    return Participation(df, ORDER).rejects()


def _order_days(spark, sf_dir, **labels):
    day = dates.iso_day(F.col("o_orderdate"))
    out = [f(day).alias(name) for name, f in labels.items()]
    return table(spark, sf_dir, "orders").select("o_orderkey", *out)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def iso_day(spark, sf_dir):
    return _order_days(spark, sf_dir, day=lambda d: d)


# Days of any month up to the 31st, so also February 30; weekdays are counted on into March.
_SHOWN = "strftime(o_orderdate, '%Y-%m-') || lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0')"
_LABELS = f"WITH d AS (SELECT o_orderkey, o_orderkey % 31 + 1 AS nr, o_orderdate, {_SHOWN} AS day FROM orders) SELECT o_orderkey, day, "


def _shown_days(spark, sf_dir, label):
    number = F.lpad((F.col("o_orderkey") % 31 + 1).cast("string"), 2, "0")
    days = table(spark, sf_dir, "orders").withColumn("day", F.concat(F.date_format("o_orderdate", "yyyy-MM-"), number))
    return days.select("o_orderkey", "day", label(F.col("day")).alias("label"))


@query(_LABELS + "strftime(o_orderdate, '%b ') || CAST(nr AS VARCHAR) AS label FROM d")
def label_short(spark, sf_dir):
    return _shown_days(spark, sf_dir, dates.label_short)


@query(_LABELS + "CAST(nr AS INTEGER) AS label FROM d")
def label_day(spark, sf_dir):
    return _shown_days(spark, sf_dir, dates.label_day)


@query(_LABELS + "strftime(o_orderdate, '%b') AS label FROM d")
def label_month(spark, sf_dir):
    return _shown_days(spark, sf_dir, dates.label_month)


@query(_LABELS + "left(dayname(CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(nr - 1 AS INTEGER)), 1) AS label FROM d")
def label_weekday(spark, sf_dir):
    return _shown_days(spark, sf_dir, dates.label_weekday)


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 6, '%Y-%m-%d') AS first_day FROM orders")
def days_back(spark, sf_dir):
    return _order_days(spark, sf_dir, first_day=lambda d: dates.days_back(d, 7))


@query(
    _survey_expr(
        "regexp_full_match(CASE _row_ord % 3 WHEN 0 THEN split_part(Response, 'T', 1) WHEN 1 THEN Response"
        " ELSE substr(Date, 3) END, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS is_day"
    )
)
def is_day_text(spark, sf_dir):
    """Days, whole answers, and days that lack their century."""
    which = F.col("_row_ord") % 3
    shown = F.when(which == 0, F.substring_index("Response", "T", 1)).when(which == 1, F.col("Response"))
    shown = shown.otherwise(F.expr("substring(Date, 3)"))
    return survey(spark, sf_dir).select("_row_ord", dates.is_day_text(shown).alias("is_day"))


@query(
    with_(SURVEY)
    + "SELECT _row_ord, split_part(Response, 'T', 1) AS day FROM survey"
    " WHERE QuestionsType <> 'Incentives' AND Response <> ''"
)
def flt_valid_day(spark, sf_dir):
    answers = survey(spark, sf_dir).filter("QuestionsType <> 'Incentives'")
    return r.valid_days(answers.select("_row_ord", dates.event_day(F.col("Response")).alias("day")))


@query(
    with_(SURVEY, DAILY)
    + """, last AS (SELECT max(CAST(day AS DATE)) AS d FROM daily), seq AS (
  SELECT strftime(unnest(generate_series(d - INTERVAL 29 DAY, d, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM last)"""
    " SELECT seq.day, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM seq LEFT JOIN daily USING (day) GROUP BY 1"
)
def day_sequence(spark, sf_dir):
    """The 30 days that end with the newest day of the data, with their entries."""
    daily = Participation(survey(spark, sf_dir), ORDER).daily
    newest = ranges.max_day(daily).first().day
    counts = daily.groupBy("day").agg(F.sum("n").alias("n"))
    days = dates.day_sequence(spark, newest)
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query(_survey_expr("CASE WHEN PromptID = 'view' THEN Date ELSE RespondedAt END AS answered"))
def answer_time(spark, sf_dir):
    """Views have no ``RespondedAt`` here, so their upload time stands in."""
    gaps = _without_time(survey(spark, sf_dir), F.col("PromptID") == "view")
    return gaps.select("_row_ord", dates.answer_time().alias("answered"))


@query(
    _survey_expr(
        "CASE WHEN PromptID = 'view' THEN Response WHEN PromptID = 'error' THEN '' ELSE RespondedAt END AS answered"
    )
)
def incentive_time(spark, sf_dir):
    gaps = _without_time(survey(spark, sf_dir), F.col("PromptID").isin("view", "error"))
    no_date = gaps.withColumn("Date", F.when(F.col("RespondedAt") != "", F.col("Date")).otherwise(""))
    return no_date.select("_row_ord", dates.incentive_time().alias("answered"))


def _without_time(df, where):
    return df.withColumn("RespondedAt", F.when(where, "").otherwise(F.col("RespondedAt")))


@query(f"SELECT doc_id, trim(text, {BLANKS}) AS text FROM documents")
def ws_trim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.ws_trim(F.col("text")).alias("text"))


BLANKED = [" None ", "NULL", "\t", "undefined", "nonesuch", "null."]


@query(
    "SELECT conv_id, turn, CASE WHEN turn % 8 < 4 OR turn % 8 = 6 AND text IS NULL THEN true WHEN turn % 8 < 6 THEN false"
    " ELSE lower(trim(text)) IN ('', 'none', 'null', 'undefined') END AS is_blank FROM conversations"
)
def is_blank_word(spark, sf_dir):
    """Of eight turns four are made blank words, two nearly so, and two left as they are."""
    said = F.col("text")
    for i, word in enumerate(BLANKED):
        said = F.when(F.col("turn") % 8 == i, word).otherwise(said)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_blank_word(said).alias("is_blank"))


@query(
    "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_tax * 100 + 0.5) / 100.0 AS tax FROM lineitem"
)
def round_half_up2(spark, sf_dir):
    tax = F.col("l_extendedprice") * F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.round_half_up2(tax).alias("tax")
    )


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def empty_default(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", text.empty_default(F.col("quality"), -1).alias("quality"))


# Ties go up, as in 1.25 KB = 1.3 KB; the SQL ``printf`` alone would round to even.
@query(
    "SELECT doc_id, CASE WHEN n_chars <= 0 THEN '0 B' WHEN n_chars < 1024 THEN printf('%d B', n_chars)"
    " WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 102.4 + 0.5) / 10)"
    " ELSE printf('%.1f MB', floor(n_chars / 104857.6 + 0.5) / 10) END AS label FROM documents"
)
def size_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numbers.size_label(F.col("n_chars")).alias("label"))


def _typed_lines(spark, sf_dir):
    """Survey rows as JSON lines with type tags."""
    df = survey(spark, sf_dir)
    tagged = [
        F.struct(F.col("ParticipantID").alias("S")).alias("ParticipantID"),
        F.struct(F.col("Response").alias("S")).alias("Response"),
        F.struct(F.col("_row_ord").cast("string").alias("N")).alias("n"),
        (F.col("QuestionsType") == "end_time").alias("ended"),
    ]
    return df.select("_row_ord", F.to_json(F.struct(*tagged)).alias("line"))


@query(
    _survey_expr(
        "ParticipantID, Response, CAST(_row_ord AS VARCHAR) AS n,"
        " CASE WHEN QuestionsType = 'end_time' THEN 'true' ELSE 'false' END AS ended"
    )
)
def src_typed_json(spark, sf_dir):
    return flatten_typed_json(_typed_lines(spark, sf_dir), "line")


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events", "first_tag_value")
def first_tag(spark, sf_dir):
    """``props`` is an object with one key."""
    return table(spark, sf_dir, "events").select("event_id", first_tag_value(F.col("props")).alias("value"))

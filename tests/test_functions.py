import datetime as dt

import pytest

from rollcall.columns import norm_header, norm_header_text, rename_resolved, resolve_columns
from rollcall.functions import dates, numbers, text
from pyspark.sql import functions as F


def value(spark, data, expr, kind="string"):
    df = spark.createDataFrame([(data,)], f"v {kind}")
    return df.select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "given, by_text, by_utc",
    [
        ("2025-08-14T22:04:21.678396", "2025-08-14", "2025-08-14"),
        ("2025-08-14T22:04:21-05:00", "2025-08-14", "2025-08-15"),
        ("2025-08-14 22:04", "2025-08-14", "2025-08-14"),
        ("8/14/2025", "2025-08-14", "2025-08-14"),
        ("8/14/2025 10:30", "2025-08-14", "2025-08-14"),
        ("Aug 14, 2025", "2025-08-14", "2025-08-14"),
        ("Fri Aug 15 2025", "2025-08-15", "2025-08-15"),
        ("August 14, 2025", "2025-08-14", "2025-08-14"),
        ("14 Aug 2025", "2025-08-14", "2025-08-14"),
        ("", None, None),
        (None, None, None),
        ("Today", None, None),
        ("12:30", None, None),
        ("12345", None, None),
        ("2025-08-14T", "2025-08-14", None),
        ("xT1", "x", None),
        ("2025-13-45", None, None),
    ],
)
def test_event_day(spark, given, by_text, by_utc):
    assert value(spark, given, lambda c: dates.event_day(c, "text")) == by_text
    assert value(spark, given, lambda c: dates.event_day(c, "utc")) == by_utc


def test_event_day_policy_is_checked():
    with pytest.raises(ValueError):
        dates.event_day(F.lit("x"), "local")


def test_labels(spark):
    def label(f):
        return value(spark, "2025-08-04", f)

    assert label(dates.label_short) == "Aug 4"
    assert label(dates.label_day) == 4
    assert label(dates.label_month) == "Aug"
    assert label(dates.label_weekday) == "M"
    assert value(spark, "2025-08-99", dates.label_short) is None
    assert value(spark, dt.date(2025, 8, 4), dates.iso_day, "date") == "2025-08-04"


def test_day_text(spark):
    assert value(spark, "2025-08-04", dates.is_day_text) is True
    assert value(spark, "2025-8-4", dates.is_day_text) is False


def test_day_windows(spark):
    assert value(spark, "2025-03-01", lambda c: dates.days_back(c, 2)) == "2025-02-28"
    assert dates.day_range("2025-03-01", 3) == ["2025-03-01", "2025-02-28", "2025-02-27"]
    frame = [r.day for r in dates.day_sequence(spark, "2025-03-01").collect()]
    assert frame == dates.day_range("2025-03-01", 30)


@pytest.mark.parametrize(
    "given, expected", [(1.005, 1.0), (1.665, 1.67), (2.5, 2.5), (5 / 3, 1.67), (0.0, 0.0), (1.125, 1.13)]
)
def test_round_half_up2(spark, given, expected):
    assert value(spark, given, numbers.round_half_up2, "double") == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        (0, "0 B"),
        (-1, "0 B"),
        (None, "0 B"),
        (512, "512 B"),
        (1023, "1023 B"),
        (1024, "1.0 KB"),
        (1536, "1.5 KB"),
        (1024**2, "1.0 MB"),
        (5 * 1024**4, "5.0 TB"),
        (2048 * 1024**4, "2048.0 TB"),
    ],
)
def test_size_label(spark, given, expected):
    assert value(spark, given, numbers.size_label, "bigint") == expected


@pytest.mark.parametrize(
    "given, expected",
    [("all", None), ("7", 7), ("7days", 7), (" 15", 15), ("0", None), ("-3", None), ("abc", None), (30, 30)],
)
def test_days_option(given, expected):
    assert numbers.parse_days_option(given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("7", 7), ("0", 0), ("4294967294", 4294967294)],
)
def test_whole_number_ids(spark, given, expected):
    assert value(spark, given, numbers.id_rank) == expected


@pytest.mark.parametrize("given", ["07", "4294967295", "9999999999", "p1", "-1", "", None])
def test_other_ids_rank_last(spark, given):
    assert value(spark, given, numbers.id_rank) == 4294967295


def test_trim_takes_every_blank(spark):
    assert value(spark, "\u00a0\t a b\u3000\ufeff\n", text.ws_trim) == "a b"


@pytest.mark.parametrize("given", [None, "", " ", "None", " NULL ", "undefined", "\u00a0"])
def test_blank_words(spark, given):
    assert value(spark, given, text.is_blank_word) is True


@pytest.mark.parametrize("given", ["NA", "none!", "user", "x none", "nullnull", "0"])
def test_other_words_are_not_blank(spark, given):
    assert value(spark, given, text.is_blank_word) is False


def test_header_names(spark):
    assert norm_header("\ufeff Prompt_ID ") == "promptid"
    assert norm_header("Responded-At") == "respondedat"
    found = resolve_columns([" Prompt_ID", "prompt id", "DATE"])
    assert found == {"PromptID": " Prompt_ID", "Date": "DATE"}
    df = spark.createDataFrame([("a",)], "`participant id` string")
    with pytest.raises(ValueError, match="PromptID, RespondedAt, Date"):
        rename_resolved(df)
    assert rename_resolved(df, ["ParticipantID"]).columns == ["ParticipantID"]


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("8/14/2025, 3:05:00 PM", "2025-08-14"),
        ("8/14/2025 3:05 PM", "2025-08-14"),
        ("2025/08/14", "2025-08-14"),
        ("14 August 2025", "2025-08-14"),
        ("8-14-2025", "2025-08-14"),
        ("Thu, 14 Aug 2025 10:00:00 GMT", "2025-08-14"),
        ("Thu Aug 14 2025 10:00:00 GMT+0200 (CEST)", "2025-08-14"),
        ("Thu Aug 14 2025 01:30:00 GMT+0200 (Central European Summer Time)", "2025-08-13"),
        ("Thu Aug 14 2025 23:45:00 GMT-0030", "2025-08-15"),
        ("8/14/2025 12:10 am", "2025-08-14"),
        ("Thursday, August 14, 2025", "2025-08-14"),
        ("8/14/2025 13:05 PM", None),
        ("2/30/2025", None),
        ("3:05 PM", None),
        ("14 2025", None),
        ("8/14/25", None),
        ("", None),
        (None, None),
    ],
)
def test_days_as_browsers_write_them(spark, text, day):
    assert value(spark, text, lambda c: dates.event_day(c, "utc")) == day


def test_labels_of_days_in_no_calendar(spark):
    got = [value(spark, "2025-02-30", f) for f in (dates.label_short, dates.label_day, dates.label_month, dates.label_weekday)]
    assert got == ["Feb 30", 30, "Feb", "S"]  # March 2, 2025 is a Sunday
    assert value(spark, "2025-13-01", dates.label_short) is None and value(spark, "x", dates.label_day) is None


@pytest.mark.parametrize("header", [" Prompt_ID", "\ufeffparticipant id\u00a0", "DATE", "Responded-At\t", "", None, "\u3000Ünï_code"])
def test_headers_reduce_alike_as_text_and_in_a_column(spark, header):
    assert value(spark, header, norm_header_text) == norm_header(header)

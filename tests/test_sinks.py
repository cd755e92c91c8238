import datetime as dt
import glob
import gzip

import pytest
from conftest import rows

from rollcall import sinks
from rollcall.operators.rows import transcripts
from rollcall.plans.participation import Participation
from rollcall.sources.csv import read_csv
from test_cleaning import F3
from test_participation import COLUMNS, F2


def text(path):
    return [line for f in sorted(glob.glob(f"{path}/part-*")) for line in open(f, newline="").read().split("\n") if line]


AWKWARD = [
    ("a,b", 'say "hi"', "two\nlines"),
    ("", " padded ", "NA"),
    ("null", "'", "\\"),
    ("=1", "#x", "\t"),
]


def test_round_trip(table, spark, tmp_path):
    df = table(("x", "y", "z"), AWKWARD)
    sinks.write_csv(df, str(tmp_path / "o"))
    back = read_csv(spark, str(tmp_path / "o"), trim=False)
    assert rows(back) == rows(df.drop("_row_ord"))


def test_quoting(table, tmp_path):
    df = table(("x", "y"), [("a,b", 'q"q'), ("plain", "")]).coalesce(1).orderBy("_row_ord")
    sinks.write_csv(df, str(tmp_path / "o"))
    assert text(tmp_path / "o") == ["x,y", '"a,b","q""q"', "plain,"]


def test_gzip_by_suffix(table, spark, tmp_path):
    df = table(("x",), [("1",), ("2",)])
    sinks.write_csv(df, str(tmp_path / "o.csv.gz"))
    parts = glob.glob(f"{tmp_path}/o.csv.gz/part-*.csv.gz")
    assert sorted(x for p in parts for x in gzip.open(p, "rt").read().split() if x != "x") == ["1", "2"]
    assert rows(read_csv(spark, str(tmp_path / "o.csv.gz"))) == [("1",), ("2",)]


@pytest.mark.parametrize(
    "base, expected",
    [("out/data.csv", "out/data_2025-08-14.csv"), ("data", "data_2025-08-14"), ("a.b/x.csv.gz", "a.b/x_2025-08-14.csv.gz")],
)
def test_dated_path(base, expected):
    assert sinks.dated_path(base, dt.date(2025, 8, 14)) == expected
    assert sinks.dated_path(base, "2025-08-14") == expected


def test_report(table, spark, tmp_path):
    done = Participation(table(COLUMNS, F2), order_by=["_row_ord"])
    sinks.write_report(done.summary(), done.audio(), str(tmp_path / "r"))
    assert text(tmp_path / "r/summary")[0] == "ParticipantID,TotalEntries,2025-08-15,2025-08-14,2025-08-13"
    back = read_csv(spark, str(tmp_path / "r/summary"))
    assert rows(back) == [("10", "1", "1", "0", "0"), ("2", "2", "0", "0", "1"), ("p1", "2", "0", "2", "0")]
    assert rows(read_csv(spark, str(tmp_path / "r/audio"))) == [("10", "2", "1", "0", "0")]


def test_cleaned(table, spark, tmp_path):
    df = table(("PromptID", "ParticipantID", "RespondedAt", "Date"), F3)
    sinks.write_cleaned(df, str(tmp_path / "c"), ["_row_ord"])
    lines = [x for x in text(tmp_path / "c") if not x.startswith("Prompt")]
    assert lines == [",".join(F3[i - 1]) for i in (2, 4, 5, 7, 8, 9)]


F4 = [
    ("2025-08-14", "ref1", 'hello, "you"'),
    ("2025-08-14", " ", "x"),
    ("2025-08-14", " ", "x"),
    ("2025-08-15", "ref2", None),
    ("2025-08-15", None, "y"),
]


def test_transcripts(table, spark, tmp_path):
    df = table(("Date", "Reference", "Transcript"), F4)
    expected = [("2025-08-14", "ref1", 'hello, "you"'), ("2025-08-15", "ref2", "")]
    assert rows(transcripts(df)) == expected
    assert rows(transcripts(df.drop("Transcript"))) == [(a, b, "") for a, b, _ in expected]
    assert transcripts(df.drop("Reference")).count() == 0
    sinks.write_transcripts(df, str(tmp_path / "t"))
    assert rows(read_csv(spark, str(tmp_path / "t"))) == expected


def test_parquet(table, spark, tmp_path):
    df = table(("x", "day"), [("1", "2025-08-14"), ("2", "2025-08-15")])
    sinks.write_parquet(df, str(tmp_path / "p"), ["day"])
    assert len(glob.glob(f"{tmp_path}/p/day=*")) == 2
    assert rows(spark.read.parquet(str(tmp_path / "p")), "x") == [("1",), ("2",)]


def test_summary_in_pages(spark, tmp_path, table):
    from rollcall.operators import participation as p

    daily = spark.createDataFrame([("a", f"2025-08-{i:02}", i) for i in range(1, 6)], "ParticipantID string, day string, n bigint")
    path = str(tmp_path / "pages")
    sinks.write_report(p.summary_pages(daily, None, 2), None, path)
    found = [read_csv(spark, f"{path}/summary/page={i}") for i in range(3)]
    assert [x.columns for x in found] == [
        ["ParticipantID", "TotalEntries", "2025-08-05", "2025-08-04"],
        ["ParticipantID", "2025-08-03", "2025-08-02"],
        ["ParticipantID", "2025-08-01"],
    ]
    assert [tuple(x.first()) for x in found] == [("a", "15", "5", "4"), ("a", "3", "2"), ("a", "1")]

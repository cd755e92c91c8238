import pytest
from pyspark.sql import functions as F
from conftest import plan, rows

from rollcall.operators import participation as p
from rollcall.operators import ranges, stats
from rollcall.operators.rows import day_columns, report_columns, unpivot_days
from rollcall.plans.participation import Participation

COLUMNS = ("ParticipantID", "QuestionsType", "Response", "RespondedAt", "Date")
F2 = [
    ("p1", "end_time", "2025-08-14T22:04:21", "", ""),
    ("p1", "end_time", "2025-08-14T23:00:00", "", ""),
    ("10", "end_time", "2025-08-15T09:00:00", "", ""),
    ("p1", "Incentives", "5", "2025-08-14T10:00", ""),
    ("p1", "Incentives", "7", "2025-08-15T10:00", ""),
    ("p1", "Incentives", "9", "2025-08-15T10:00", ""),
    ("2", "end_time", "2025-08-13", "", ""),
    ("2", "end_time", "garbage", "", ""),
    ("2", "end_time", "xT1", "", ""),
    ("10", "textaudio", "", "2025-08-15T11:00:00", ""),
    ("10", "audio", "", "", "2025-08-16T11:00:00"),
    ("p9", "audio", "", "bad", "2025-08-15T12:00:00"),
    ("2", "Incentives", "Ticket", "", ""),
    ("p8", "Incentives", "3", "2025-08-15T10:00", ""),
    ("p1", "end_time", "Thu Aug 14 2025", "", ""),
]
DAYS = ["2025-08-15", "2025-08-14", "2025-08-13"]


@pytest.fixture
def survey(table):
    return table(COLUMNS, F2)


@pytest.fixture
def done(survey):
    return Participation(survey, order_by=["_row_ord"])


def test_summary_wide(done):
    summary = done.summary()
    assert summary.columns == ["ParticipantID", "TotalEntries", "Incentive", *DAYS]
    assert [tuple(r) for r in summary.collect()] == [
        ("2", 2, "Ticket", 0, 0, 1),
        ("10", 1, None, 1, 0, 0),
        ("p1", 2, "7", 0, 2, 0),
    ]


def test_audio_wide(done):
    audio = done.audio()
    assert audio.columns == ["ParticipantID", "TotalTextAudio", *DAYS]
    assert rows(audio) == [("10", 2, 1, 0, 0)]


def test_stats(done):
    r = done.stats().first()
    assert (r.totalParticipants, r.totalEntries) == (3, 5)
    assert r.avgEntriesPerParticipant == 1.67
    assert tuple(r.mostActiveParticipant) == ("2", 2)
    assert tuple(r.leastActiveParticipant) == ("10", 1)
    assert (r.totalActiveDays, r.avgDailyParticipation) == (3, 1.0)


def test_ties_follow_first_seen_order(table):
    data = [(pid, "end_time", "2025-08-14T1", "", "") for pid in ("zed", "amy", "7", "03", "5")]
    done = Participation(table(COLUMNS, data), order_by=["_row_ord"])
    assert [r.ParticipantID for r in done.summary().collect()] == ["5", "7", "zed", "amy", "03"]
    r = done.stats().first()
    assert (r.mostActiveParticipant.id, r.leastActiveParticipant.id) == ("5", "03")
    assert stats.top_active(done.totals).first().id == "5"
    assert stats.least_active(done.totals).first().id == "03"


def test_participant_count_and_activity_order(done):
    assert tuple(stats.participant_count(done.totals).first()) == (3, 5)
    ordered = [r.ParticipantID for r in stats.by_activity(done.totals).collect()]
    assert ordered == ["2", "p1", "10"]


def test_chart(done):
    chart = [tuple(r) for r in done.chart().collect()]
    assert chart == [
        ("2025-08-15", 1, "Aug 15", 15, "Aug"),
        ("2025-08-14", 2, "Aug 14", 14, "Aug"),
        ("2025-08-13", 1, "Aug 13", 13, "Aug"),
    ]
    scaled = stats.chart_scaled(done.chart())
    assert [r.share for r in scaled.orderBy("date").collect()] == [0.5, 1.0, 0.5]


def test_chart_of_one_participant(done):
    assert [r.entries for r in done.chart("p1").collect()] == [0, 2, 0]
    assert done.chart("nobody").count() == 0
    assert done.chart("2", n=2).count() == 0


@pytest.mark.parametrize("option", ["all", "0", "-3", "abc", None])
def test_no_day_limit(done, option):
    assert rows(ranges.last_days(done.daily, option), "day", "n") == [
        ("2025-08-13", 1),
        ("2025-08-14", 2),
        ("2025-08-15", 1),
    ]


@pytest.mark.parametrize("option", [2, "2", "2days"])
def test_last_two_days(done, option):
    view = done.view(option)
    assert rows(view) == [
        ("10", 1, None, "2025-08-15", 1),
        ("p1", 2, "7", "2025-08-14", 2),
    ]
    assert rows(done.audio_view(option)) == [("10", 2, "2025-08-15", 1)]
    assert rows(done.view(option, "10"), "ParticipantID") == [("10",)]
    assert rows(done.view(option, "2")) == []


def test_range_is_anchored_on_the_data(done):
    assert tuple(ranges.max_day(done.daily).first()) == ("2025-08-15",)
    assert ranges.last_days(done.daily, 7).count() == 3


def test_newest_day_that_is_in_no_calendar(spark):
    days = ["2025-08-14", "2025-08-13", "2025-02-30", "junk"]
    daily = spark.createDataFrame([("p1", d, 1) for d in days[2:]] + [("p1", "2025-02-27", 1)], "ParticipantID string, day string, n int")
    assert rows(ranges.last_days(daily, 4), "day") == [("2025-02-27",), ("2025-02-30",)]
    far = spark.createDataFrame([("p1", d, 1) for d in [*days, "2025-13-45"]], "ParticipantID string, day string, n int")
    assert rows(ranges.last_days(far, 7), "day") == [("2025-13-45",)]


def test_active_participants_and_entries_in_range(done):
    in_range = ranges.last_days(done.daily, 1)
    assert rows(ranges.active_in(done.totals, in_range), "ParticipantID") == [("10",)]
    view = ranges.summary_in_range(done.daily, done.totals, 2, entries_in_range=True)
    assert rows(view, "ParticipantID", "EntriesInRange") == [("10", 1), ("p1", 2)]


def test_zero_fill(done):
    filled = p.zero_fill(done.totals, done.daily, done.day_names)
    assert filled.count() == 9
    assert rows(filled.filter("n > 0")) == [
        ("10", "2025-08-15", 1),
        ("2", "2025-08-13", 1),
        ("p1", "2025-08-14", 2),
    ]


def test_unpivot_is_the_inverse(done):
    wide = done.summary()
    assert day_columns(wide) == DAYS
    back = unpivot_days(wide, ["ParticipantID"])
    assert rows(back) == rows(p.zero_fill(done.totals, done.daily, DAYS))


def test_report_columns(done):
    assert report_columns(done.summary()).columns == ["ParticipantID", "TotalEntries", *DAYS]
    assert "Incentive" in report_columns(done.summary(), include_incentive=True).columns


def test_30_day(survey):
    wide = p.summary_30day(survey, "2025-08-15")
    assert len(day_columns(wide)) == 30
    assert day_columns(wide)[0] == "2025-08-15" and day_columns(wide)[-1] == "2025-07-17"
    got = rows(wide, "ParticipantID", "TotalEntries", *[f"`{d}`" for d in DAYS])
    # Here the parsed day counts, so `Thu Aug 14 2025` is an entry and `xT1` is none.
    assert got == [("10", 1, 1, 0, 0), ("2", 1, 0, 0, 1), ("p1", 3, 0, 3, 0)]
    audio = p.audio_30day(survey, "2025-08-15")
    assert rows(audio, "ParticipantID", "TotalTextAudio", "`2025-08-15`") == [("10", 2, 1)]


def test_window_can_miss_all_entries(survey):
    wide = p.summary_30day(survey, "2030-01-01")
    assert wide.count() == 3
    assert all(n == 0 for r in wide.collect() for n in r[2:])


def test_incentive_time_rules(table):
    data = [
        ("a", "Incentives", "none yet", "", ""),
        ("a", "Incentives", "second", "", ""),
        ("b", "Incentives", "early", "", "2025-01-02"),
        ("b", "Incentives", "late", "", "2025-01-03"),
        ("c", "Incentives", "first", "", ""),
        ("c", "Incentives", "Ticket", "", ""),
        ("d", "Incentives", "", "2025-01-03", ""),
        ("e", "Incentives", "answered", "2025-01-01", "2025-09-09"),
        ("e", "Incentives", "newer", "2025-01-02", ""),
    ]
    got = rows(p.latest_incentive(table(COLUMNS, data), ["_row_ord"]))
    assert got == [("a", "none yet"), ("b", "late"), ("c", "Ticket"), ("e", "newer")]


def test_no_end_time_rows(table):
    data = [("a", "audio", "", "2025-08-15T1", ""), ("a", "x", "", "", "")]
    done = Participation(table(COLUMNS, data), order_by=["_row_ord"])
    assert done.day_names == []
    assert done.summary().count() == 0
    assert done.audio().count() == 0
    r = done.stats().first()
    assert (r.totalParticipants, r.totalEntries, r.totalActiveDays) == (0, 0, 0)
    assert (r.avgEntriesPerParticipant, r.avgDailyParticipation) == (0.0, 0.0)
    assert r.mostActiveParticipant is None and r.leastActiveParticipant is None


def test_no_valid_day(table):
    data = [("a", "end_time", "nothing", "", ""), ("a", "audio", "", "2025-08-15T1", "")]
    done = Participation(table(COLUMNS, data), order_by=["_row_ord"])
    assert done.summary().count() == 0
    assert rows(done.audio()) == [("a", 1)]
    assert done.stats().first().totalParticipants == 0


def test_order_is_required(survey):
    with pytest.raises(ValueError, match="order_by"):
        p.latest_incentive(survey, [])


def test_too_many_days(done):
    with pytest.raises(ValueError, match="more than 2 days"):
        p.day_list(done.daily, limit=2)


def test_partitioning_does_not_matter(survey):
    one = Participation(survey.coalesce(1), order_by=["_row_ord"])
    many = Participation(survey.repartition(7), order_by=["_row_ord"])
    assert one.summary().collect() == many.summary().collect()
    assert one.stats().collect() == many.stats().collect()


def _many_days(spark, n, people=4):
    """Participants with an entry on every ``k``-th of ``n`` days; the first day is 1900-01-01."""
    day = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")
    pid = F.explode(F.sequence(F.lit(1), F.lit(people))).alias("k")
    rows_ = spark.range(n).select(day.alias("day"), "id", pid).filter("id % k = 0")
    return rows_.select(F.col("k").cast("string").alias("ParticipantID"), "day", F.lit(2).cast("bigint").alias("n"))


def test_zeros_for_more_days_than_a_table_has_columns(spark):
    n = 20_000
    daily = _many_days(spark, n)
    filled = p.zero_fill(None, daily, p.days(daily))
    got = {r.ParticipantID: r for r in filled.groupBy("ParticipantID").agg(
        F.count("*").alias("rows"), F.count_distinct("day").alias("days"), F.sum("n").alias("n")
    ).collect()}
    assert {k: (r.rows, r.days, r.n) for k, r in got.items()} == {str(k): (n, n, 2 * -(-n // k)) for k in range(1, 5)}
    assert filled.join(daily, ["ParticipantID", "day", "n"]).count() == daily.count()
    text = plan(filled)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_zeros_of_participants_and_days_that_are_not_in_the_counts(spark, done):
    people = spark.createDataFrame([("p1",), ("new",)], "ParticipantID string")
    days = spark.createDataFrame([("2025-08-14",), ("2025-08-20",), ("2025-08-14",)], "day string")
    assert rows(p.zero_fill(people, done.daily, days)) == [
        ("new", "2025-08-14", 0), ("new", "2025-08-20", 0), ("p1", "2025-08-14", 2), ("p1", "2025-08-20", 0),
    ]
    assert p.zero_fill(None, done.daily, days.limit(0)).count() == 0
    assert rows(done.zero_filled()) == rows(p.zero_fill(None, done.daily, done.day_names))


def test_pages_side_by_side_are_the_summary(spark, done):
    pages = done.summary_pages(2)
    assert [day_columns(x) for x in pages] == [DAYS[:2], DAYS[2:]]
    assert rows(pages[0].join(pages[1], "ParticipantID")) == rows(done.summary())
    daily = _many_days(spark, 2500)
    pages = p.summary_pages(daily, None, 1000)
    assert [len(day_columns(x)) for x in pages] == [1000, 1000, 500]
    assert "TotalEntries" in pages[0].columns and pages[2].columns[0] == "ParticipantID"
    back = [unpivot_days(x, ["ParticipantID"]).filter("n > 0") for x in pages]
    assert rows(back[0].union(back[1]).union(back[2])) == rows(daily, "ParticipantID", "day", "n")
    assert p.summary_pages(daily.limit(0), None, 10)[0].count() == 0


def test_rejects_are_counted_by_the_same_pass(table):
    data = [
        ("a", "end_time", "2025-08-15T1", "", ""),
        ("a", "end_time", "nothing", "", ""),
        ("b", "end_time", "xT1", "", ""),
        ("b", "audio", "", "soon", ""),
        ("b", "audio", "", "2025-08-15T1", ""),
        ("b", "other", "x", "", ""),
    ]
    for with_audio in (True, False):
        done = Participation(table(COLUMNS, data), order_by=["_row_ord"], with_audio=with_audio)
        got = rows(done.rejects())
        assert ("end_time", 3, 1, 1) in got and (("audio", 2, 1, 0) in got) == with_audio
        assert done.daily.count() == 2

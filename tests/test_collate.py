import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from rollcall.operators import dedup as d
from rollcall.operators.rows import ensure_columns, in_input_order, keys_first, preview
from rollcall.operators.sets import column_union, union_all
from rollcall.plans.collate import collate, collate_tables
from rollcall.sources.csv import file_inventory

A = (
    "﻿ResponseID,ParticipantID,QuestionsType,Response,Date\r\n"
    "r1,p1,end_time,2025-08-14T22:04:21.678396,2025-08-14T22:05:00\r\n"
    'r2,p1,Incentives,"10, cash",2025-08-14T22:06:00\r\n'
    ",p2,end_time,2025-08-15T09:00:00,2025-08-15T09:01:00\r\n"
    "r1,p1,end_time,2025-08-14T22:04:21.678396,2025-08-14T22:30:00\r\n"
)
B = (
    "ParticipantID,ResponseID,QuestionsType,Response,Note\n"
    'p2,r3,end_time,2025-08-15T10:00:00,"multi\nline ""q"""\n'
    "p3,,end_time,2025-08-13T08:00:00,\n"
    "p1,r2,Incentives,12,late\n"
)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.csv").write_bytes(A.encode())
    (tmp_path / "b.csv").write_bytes(B.encode())
    return [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]


def ids(df):
    return [(r.ResponseID, r.ParticipantID) for r in in_input_order(df).collect()]


def test_keep_first(spark, files):
    done = collate(spark, files)
    assert done.df.columns == [
        "ResponseID", "ParticipantID", "QuestionsType", "Response", "Date", "Note",
        "_file_ord", "_row_ord",
    ]
    assert tuple(done.stats.first()) == (7, 3, 4)
    assert ids(done.df) == [("r1", "p1"), ("r2", "p1"), ("", "p2"), ("r3", "p2")]
    by_id = {r.ResponseID: r for r in done.df.collect()}
    assert by_id["r1"].Date == "2025-08-14T22:05:00"
    assert by_id["r2"].Response == "10, cash"
    assert by_id["r3"].Date == "" and by_id["r1"].Note == ""
    assert by_id["r3"].Note == 'multi\nline "q"'


def test_keep_last(spark, files):
    done = collate(spark, files, keep="last")
    assert ids(done.df) == [("r1", "p1"), ("r3", "p2"), ("", "p3"), ("r2", "p1")]
    assert {r.ResponseID: r.Date for r in done.df.collect()}["r1"] == "2025-08-14T22:30:00"


def test_keep_empty_ids(spark, files):
    done = collate(spark, files, empty_keys="keep")
    assert done.df.count() == 5


def test_id_stats(spark, files):
    df = collate(spark, files).loaded.df
    r = d.id_stats(df).first()
    assert tuple(r)[:4] == (7, 4, 3, 2)
    assert r.sampleResponseIds == ["r1", "r2", "", "r3"]
    assert [x.ResponseID for x in d.sample_ids(df, n=2).collect()] == ["r1", "r2"]
    assert rows(d.id_stats_by_file(df)) == [(0, 4, 3, 1), (1, 3, 3, 0)]


def test_inventory(spark, files):
    inventory = file_inventory(collate(spark, files).loaded)
    got = rows(inventory, "_file_ord", "bytes", "rows", "columns")
    assert got == [(0, len(A.encode()), 4, 5), (1, len(B.encode()), 3, 5)]


def test_dedup_on_absent_key(spark, files):
    done = collate(spark, files, keys=["Wave"])
    assert done.df.columns[0] == "Wave"
    assert ids(done.df) == [("r1", "p1")]


def test_dedup_all_columns(table):
    df = table(("a", "b"), [("1", "x"), ("1", None), ("1", "x"), ("1", ""), ("2", "x")])
    assert rows(d.dedup(df, None, ["_row_ord"])) == [(1, "1", "x"), (2, "1", ""), (5, "2", "x")]
    last = d.dedup(df, None, ["_row_ord"], keep="last")
    assert rows(last) == [(3, "1", "x"), (4, "1", ""), (5, "2", "x")]
    swapped = d.dedup(df.select("b", "_row_ord", "a"), None, ["_row_ord"])
    assert rows(swapped, "_row_ord") == [(1,), (2,), (5,)]


def test_all_columns_with_two_ordinals(spark, files):
    df = collate(spark, files).loaded.df
    twice = df.union(df.withColumn("_file_ord", F.col("_file_ord") + 10))
    once = d.dedup(twice, None)
    assert rows(once) == rows(df)


def test_key_parts_do_not_run_together(table):
    df = table(("a", "b"), [("x|y", "z"), ("x", "y|z")])
    assert d.dedup(df, ["a", "b"], ["_row_ord"]).count() == 2


def test_null_and_empty_are_one_key(table):
    df = table(("k",), [("",), (None,), ("x",)])
    assert rows(d.dedup(df, ["k"], ["_row_ord"])) == [(1, ""), (3, "x")]
    assert tuple(d.dedup_stats(df, ["k"]).first()) == (3, 1, 2)


def test_dedup_is_idempotent_and_adds_up(table):
    df = table(("k",), [(str(i * i % 7),) for i in range(50)])
    once = d.dedup(df, ["k"], ["_row_ord"])
    assert rows(d.dedup(once, ["k"], ["_row_ord"])) == rows(once)
    r = d.dedup_stats(df, ["k"]).first()
    assert r.rows_after == once.count() and r.rows_before == r.rows_removed + r.rows_after


def test_hot_key_shrinks_before_the_shuffle(table):
    df = table(("k",), [("hot",)] * 40 + [("cold",)])
    text = plan(d.dedup(df, ["k"], ["_row_ord"]))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_dedup_arguments(table):
    df = table(("k",), [("a",)])
    for bad in ({"keep": "any"}, {"empty_keys": "drop"}, {"order_by": []}):
        with pytest.raises(ValueError):
            d.dedup(df, ["k"], **{"order_by": ["_row_ord"], **bad})


def test_union_by_name(spark):
    one = spark.createDataFrame([("1", 5)], "a string, n int")
    two = spark.createDataFrame([("x", None)], "b string, a string")
    assert column_union([one, two]) == ["a", "n", "b"]
    assert rows(union_all([one, two])) == [("", None, "x"), ("1", 5, "")]


def test_names_that_differ_by_case_only(spark):
    one, two = spark.createDataFrame([("1",)], "Date string"), spark.createDataFrame([("2",)], "date string")
    with pytest.raises(ValueError, match="caseSensitive"):
        union_all([one, two])
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert rows(union_all([one, two])) == [("", "2"), ("1", "")]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_many_frames(spark):
    frames = [spark.createDataFrame([(str(i),)], f"c{i % 3} string") for i in range(40)]
    assert union_all(frames).count() == 40


def test_collate_tables(spark):
    one = spark.createDataFrame([("k1", 1), ("k2", 2)], "id string, ord int")
    two = spark.createDataFrame([("k1", 3, "n")], "id string, ord int, note string")
    done = collate_tables([one, two], ["id"], ["ord"])
    assert rows(done.df) == [("k1", 1, ""), ("k2", 2, "")]
    assert tuple(done.stats.first()) == (3, 1, 2)
    whole = collate_tables([one, one], None, ["ord"])
    assert tuple(whole.stats.first()) == (4, 2, 2)


def test_column_helpers(table):
    df = table(("a", "b"), [("1", "2")])
    assert ensure_columns(df, ["a", "c"]).columns == ["_row_ord", "a", "b", "c"]
    assert keys_first(df, ["b", "a"]).columns == ["b", "a", "_row_ord"]


def test_preview(table):
    df = table(("a",), [(str(i),) for i in range(20)])
    assert [r.a for r in preview(df, 3, ["_row_ord"]).collect()] == ["0", "1", "2"]

"""Shapes of physical plans that matter at scale."""

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from rollcall.operators import dedup as d
from rollcall.operators import participation as p
from rollcall.operators import ranges, stats
from rollcall.operators.rows import end_time_rows, in_input_order, preview
from test_participation import COLUMNS, F2


@pytest.fixture
def stored(table, spark, tmp_path):
    extra = table((*COLUMNS, "ResponseID"), [(*r, str(i % 5)) for i, r in enumerate(F2)])
    extra.write.parquet(str(tmp_path / "s"))
    return spark.read.parquet(str(tmp_path / "s"))


def test_kind_filter_and_columns_reach_the_scan(stored):
    text = plan(p.daily_entries(stored))
    assert "EqualTo(QuestionsType,end_time)" in text
    assert "ReadSchema: struct<ParticipantID:string,QuestionsType:string,Response:string>" in text
    text = plan(p.daily_series(stored))
    assert "PushedFilters" in text and "In(QuestionsType, [audio,textaudio])" in text


def test_counts_merge_before_the_only_shuffle(stored):
    text = plan(p.daily_entries(stored))
    assert text.count("Exchange") == 1
    assert text.index("Exchange") < text.index("partial_count")
    assert "Window" not in text and "Join" not in text


def test_wide_table_moves_narrow_rows_once(stored):
    daily = p.daily_entries(stored)
    text = plan(p.summary_wide(daily, None, None, ["2025-08-15", "2025-08-14"]))
    # One shuffle for the counts, one to the participant, none for the pivot.
    assert text.count("Exchange") == 2
    assert text.index("partial_pivotfirst") < text.index("REPARTITION_BY_COL")
    assert "Join" not in text


def test_zeros_are_not_joined(stored):
    daily = p.daily_entries(stored)
    text = plan(p.zero_fill(None, daily, ["2025-08-15", "2025-08-14"]))
    assert "Expand" in text or "Generate" in text
    assert "Join" not in text and text.count("Exchange") == 2


def test_incentives_shrink_before_the_shuffle(stored):
    text = plan(p.latest_incentive(stored, ["_row_ord"]))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")
    assert "EqualTo(QuestionsType,Incentives)" in text


def test_newest_day_is_a_subquery(stored):
    text = plan(ranges.last_days(p.daily_entries(stored), 7))
    assert "Subquery" in text and "Join" not in text


def test_figures_need_no_join(stored):
    daily = p.daily_entries(stored)
    text = plan(stats.participation_stats(daily, p.total_entries(daily)))
    assert "Join" not in text and "Window" not in text


def test_nothing_is_a_cartesian_product(stored):
    daily = p.daily_entries(stored, order_by=["_row_ord"])
    frames = [
        stats.chart_participant(daily, "p1"),
        stats.chart_scaled(stats.chart_daily(daily)),
        ranges.summary_in_range(daily, p.total_entries(daily), 7),
        d.id_stats(stored, order_by=["_row_ord"]),
    ]
    for df in frames:
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_first_rows_are_taken_per_task(stored):
    assert "TakeOrderedAndProject" in plan(preview(stored, 3, ["_row_ord"]))
    assert "rangepartitioning" in plan(in_input_order(stored, ["_row_ord"]))


def test_identical_rows_merge_before_the_shuffle(stored):
    text = plan(d.dedup(stored, None, ["_row_ord"]))
    assert text.index("Exchange") < text.index("partial_min")
    assert "Window" not in text


def test_row_filter_is_no_more_than_a_filter(stored):
    assert "Exchange" not in plan(end_time_rows(stored))


def test_hot_participant_is_one_row_per_day(spark):
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 1000).cast("string")))
    survey = spark.range(0, 30_000, 1, 8).select(
        F.col("id").alias("_row_ord"),
        hot.alias("ParticipantID"),
        F.lit("end_time").alias("QuestionsType"),
        F.concat(F.lit("2025-08-1"), (F.col("id") % 5).cast("string"), F.lit("T10:00")).alias("Response"),
    )
    daily = p.daily_entries(survey)
    assert daily.filter("ParticipantID = 'hot'").count() == 5
    assert p.total_entries(daily).filter("ParticipantID = 'hot'").first().TotalEntries == 10_000


def test_file_ordinals_are_aggregated_without_a_sort(spark, stored):
    from rollcall.columns import ORD
    from rollcall.operators.rows import first_seen

    df = stored.withColumn("_file_ord", F.lit(1))
    for done in (
        p.daily_entries(df, order_by=ORD),
        p.daily_audio(df, order_by=ORD),
        first_seen(df, "ParticipantID", ORD),
        d.sample_ids(df, order_by=ORD),
        d.dedup(df, None, ORD),
    ):
        assert "SortAggregate" not in plan(done) and "HashAggregate" in plan(done)
    assert rows(d.dedup(df, None, ORD)) == rows(d.dedup(df, None, ["_row_ord"]))


def test_id_figures_make_one_aggregate(stored):
    figures = d.id_stats(stored, order_by=["_row_ord"])
    figures.collect()
    assert "ReusedExchange" in plan(figures) or "ReusedQueryStage" in plan(figures) or "ReusedSubquery" in plan(figures)


def test_stored_collate_is_neither_parsed_nor_settled_again(spark, tmp_path):
    from rollcall.plans.cleaning import Cleaning
    from rollcall.plans.collate import collate
    from rollcall.plans.participation import Participation

    names = ("ResponseID", *COLUMNS, "PromptID")
    head = ",".join(dict.fromkeys(names))
    lines = [f"r{i % 7}," + ",".join("x" for _ in dict.fromkeys(names[1:])) for i in range(20)]
    (tmp_path / "a.csv").write_text("\n".join([head, *lines]) + "\n")
    merged = collate(spark, str(tmp_path / "a.csv"))
    assert merged.df.count() == 7 and merged.stats.first().rows_before == 20
    for result in (Cleaning(merged.df).cleaned(), Participation(merged.df).summary(), Participation(merged.df).incentive, merged.df):
        text = plan(result)
        assert "csv" not in text.lower().replace(str(tmp_path).lower(), "") and "FileScan parquet" in text
    assert "Window" not in plan(merged.df) and "Window" in plan(collate(spark, str(tmp_path / "a.csv"), store=False).df)

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from rollcall.columns import rename_resolved
from rollcall.operators import cleaning as c
from rollcall.operators import joins

F3 = [
    ("q1", "p1", "t1", "2025-08-14T10:00"),
    ("q1", "p1", "t1", "2025-08-14T1:00"),
    ("q2", "p1", "t1", "2025-01-02"),
    ("q2", "p1", "t1", ""),
    ("q3", "p1", "t1", "2025-01-02"),
    ("q3", "p1", "t1", "2025-01-02"),
    ("q4", "p1", "None", "2025-01-02"),
    ("q4", "p1", "None", "2025-01-03"),
    ("q5", "p1", "t1", "2025-01-02"),
]
ORDER = {"order_by": ["_row_ord"]}


@pytest.fixture
def uploads(table):
    return rename_resolved(table((" Prompt_ID", "participant id", "Responded-At", "DATE"), F3))


def places(df):
    return [r[0] for r in rows(df, "_row_ord")]


def test_clean(uploads):
    assert places(c.clean(uploads, **ORDER)) == [2, 4, 5, 7, 8, 9]
    assert places(c.clean_removed(uploads, **ORDER)) == [1, 3, 6]
    assert tuple(c.cleaning_stats(uploads, **ORDER).first()) == (9, 3, 3, 6)


def test_require_date(uploads):
    assert places(c.clean(uploads, **ORDER, require_date=True)) == [2, 3, 4, 5, 7, 8, 9]
    assert places(c.clean_removed(uploads, **ORDER, require_date=True)) == [1, 6]
    assert tuple(c.cleaning_stats(uploads, **ORDER, require_date=True).first()) == (9, 2, 2, 7)


def test_groups(uploads):
    groups = c.duplicate_groups(uploads, **ORDER).orderBy("first_ord")
    got = [tuple(r) for r in groups.select("PromptID", "n", "n_distinct_dates", "first_ord").collect()]
    assert got == [("q1", 2, 2, 1), ("q2", 2, 2, 3), ("q3", 2, 1, 5)]
    few = c.duplicate_groups(uploads, **ORDER, limit=2)
    assert [r.PromptID for r in few.collect()] == ["q1", "q2"]


def test_review(uploads):
    got = [(r.Status, r._row_ord) for r in c.clean_review(uploads, **ORDER).collect()]
    assert got == [
        (c.KEPT, 2), (c.REMOVED, 1), (c.KEPT, 4), (c.REMOVED, 3), (c.KEPT, 5), (c.REMOVED, 6),
    ]
    assert c.clean_review(uploads, **ORDER, groups=1).count() == 2


def test_missing_date_column(uploads):
    with pytest.raises(ValueError, match="Date"):
        c.clean(uploads.drop("Date"), **ORDER)


def test_kept_and_removed_make_up_the_input(spark, uploads):
    copies = F.explode(F.sequence(F.lit(0), F.lit(4)))
    big = uploads.withColumn("copy", copies)
    big = big.withColumn("_row_ord", F.col("_row_ord") * 10 + F.col("copy"))
    both = c.clean(big, **ORDER).union(c.clean_removed(big, **ORDER))
    assert rows(both, "_row_ord") == rows(big, "_row_ord")
    again = c.clean(c.clean(big, **ORDER), **ORDER)
    assert rows(again) == rows(c.clean(big, **ORDER))


def test_two_ordinals(uploads):
    df = uploads.withColumn("_file_ord", F.lit(0))
    removed = c.clean_removed(df)
    assert places(removed) == [1, 3, 6]
    assert places(c.clean(df)) == [2, 4, 5, 7, 8, 9]


def test_few_repeats_leave_the_other_rows_in_place(uploads):
    text = plan(c.clean(uploads, **ORDER))
    assert "BroadcastHashJoin" in text
    # one shuffle, of the repeated keys' rows alone: the first of each key and task
    shuffled = text.split("Exchange hashpartitioning")
    assert len(shuffled) == 2
    assert "Partial" in shuffled[1]
    assert "BroadcastHashJoin" in shuffled[1]


def test_places_may_change_between_scans(uploads):
    repeated = c.repeated_keys(uploads, **ORDER)
    moved = uploads.withColumn("_row_ord", F.col("_row_ord") * 100)
    assert places(c.clean(moved, **ORDER, repeated=repeated)) == [200, 400, 500, 700, 800, 900]
    assert places(c.clean_removed(moved, **ORDER, repeated=repeated)) == [100, 300, 600]


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)


def test_many_repeats(uploads, no_broadcast):
    test_clean(uploads)
    test_require_date(uploads)
    test_review(uploads)


def test_many_repeats_shrink_before_the_shuffle(uploads, no_broadcast):
    text = plan(c.clean(uploads, **ORDER))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_size_of_the_small_side(spark):
    df = spark.createDataFrame([("abc", 1), (None, 2), ("\u00e9", 3)], "k string, n int")
    assert joins.measured_bytes(df) == 3 * 48 + 3 + 2
    assert joins.measured_bytes(df.limit(0)) == 0


def test_keys_that_share_a_hash_are_told_apart(uploads, monkeypatch):
    monkeypatch.setattr(c.F, "xxhash64", lambda *cols: F.lit(1).cast("bigint"))
    test_clean(uploads)
    test_groups(uploads)


def _hot(spark):
    """One key with a third of all rows, and pairs."""
    pair = F.concat(F.lit("q"), (F.col("id") / 2).cast("int"))
    return spark.range(0, 60_000, 1, 12).select(
        F.col("id").alias("_row_ord"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(pair).alias("PromptID"),
        F.lit("p").alias("ParticipantID"),
        F.lit("t").alias("RespondedAt"),
        F.format_string("%09d", 100_000 - F.col("id")).alias("Date"),
        F.repeat(F.lit("x"), 50).alias("pad"),
    )


def _check_hot(spark, removed, kept):
    assert removed.filter("PromptID = 'hot'").count() == 19_999
    assert kept.filter("PromptID = 'hot'").first()._row_ord == 59_997
    assert removed.count() + kept.count() == 60_000
    assert kept.groupBy("PromptID").count().filter("count > 1").count() == 0


def test_hot_group(spark):
    df = _hot(spark)
    _check_hot(spark, c.clean_removed(df, **ORDER), c.clean(df, **ORDER))


def test_hot_group_is_split_in_a_shuffled_join(spark, no_broadcast):
    df = _hot(spark)
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        removed = c.clean_removed(df, **ORDER)
        removed.collect()
        assert "skew=true" in plan(removed)
        _check_hot(spark, removed, c.clean(df, **ORDER))
    finally:
        for key in settings:
            spark.conf.unset(key)

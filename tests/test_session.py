from pyspark.sql import functions as F

from conftest import rows
from rollcall.session import once, scratch_dir


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark).startswith(shared + "/")
    assert scratch_dir(spark) != scratch_dir(spark)


def test_once_computes_once(spark):
    drawn = spark.range(20).select("id", F.rand().alias("x"), F.struct("id").alias("s"))
    kept = once(drawn)
    assert kept.schema == drawn.schema or kept.columns == drawn.columns
    assert rows(kept) == rows(kept)


def test_once_keeps_the_schema_of_an_empty_frame(spark):
    kept = once(spark.range(5).filter("id > 9"))
    assert kept.columns == ["id"] and kept.count() == 0

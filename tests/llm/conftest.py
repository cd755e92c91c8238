import pytest

SCHEMA = "doc_id bigint, text string"


@pytest.fixture
def docs(spark):
    """A table of (doc_id, text) with extra columns whose names the operators use themselves."""

    def make(rows, partitions=3):
        df = spark.createDataFrame([(i, t, "x", 1, 2, "id") for i, t in rows], SCHEMA + ", k string, h int, row int, id string")
        return df.repartition(partitions)

    return make


def prose(seed, n, start=0):
    """Words that hardly repeat, different for each seed."""
    return " ".join(f"w{(seed * 7919 + i * 104729) % 1000003}" for i in range(start, start + n))

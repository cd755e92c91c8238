"""Session settings this library expects, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the results rely on (zone, case of names) or that keep skewed joins
#: and partition sizes in hand. Cluster size and memory are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "rollcall", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new path for files that are written and read back by one query.

    It lies in the folder the cluster shares (``spark.checkpoint.dir``). Only a
    local session, whose tasks all run on this machine, may do without.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/rollcall-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="rollcall-")


def once(df: DataFrame) -> DataFrame:
    """Compute a frame now, for several results to start from.

    The rows become a table in the shared folder, so a lost executor does not bring
    the work back. Meant for narrow aggregates, which are small beside their source.
    """
    path = f"{scratch_dir(df.sparkSession)}/once"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

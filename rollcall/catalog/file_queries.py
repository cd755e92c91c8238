"""Tables written as CSV and read back, in the folder the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall import sinks
from rollcall.catalog.cleaning_queries import MARKED, TRANSCRIPTS, _talk
from rollcall.catalog.participation_queries import ANCHOR_INSIDE, DAYS_INSIDE, _analysis
from rollcall.catalog.registry import query
from rollcall.catalog.survey_view import (
    AUDIO_DAILY,
    AUDIO_TOTALS,
    DAILY,
    DAYS,
    ORDER,
    SURVEY,
    TOTALS,
    survey,
    table,
    with_,
)
from rollcall.operators import participation as p
from rollcall.operators.rows import in_input_order
from rollcall.plans.collate import collate
from rollcall.session import scratch_dir
from rollcall.sources import csv
from rollcall.sources.files import discover, find_files

ORDERS = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,"
    " o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders"
)
DOCUMENTS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents"


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus",
        "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
    )


def _documents(spark, sf_dir) -> DataFrame:
    """Prose with commas, quotes and line ends."""
    columns = [F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source"]
    return table(spark, sf_dir, "documents").select(*columns)


def _written(spark, df: DataFrame, suffix: str = "", **options) -> str:
    path = scratch_dir(spark) + "/data" + suffix
    sinks.write_csv(df, path, **options)
    return path


@query(ORDERS)
def src_csv(spark, sf_dir):
    return csv.read_csv(spark, _written(spark, _orders(spark, sf_dir)))


@query(ORDERS)
def src_csv_single_line(spark, sf_dir):
    return csv.read_csv(spark, _written(spark, _orders(spark, sf_dir)), multiline=False)


@query(ORDERS)
def src_csv_options(spark, sf_dir):
    path = scratch_dir(spark) + "/data"
    _orders(spark, sf_dir).write.options(header=True, sep=";", encoding="UTF-16LE").csv(path)
    return csv.read_csv(spark, path, sep=";", encoding="UTF-16LE")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'NA' ELSE 'null' END AS word FROM supplier")
def src_all_text(spark, sf_dir):
    words = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.when(F.col("s_nationkey") % 2 == 0, "NA").otherwise("null").alias("word"),
    )
    return csv.read_csv(spark, _written(spark, words))


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS name FROM customer"
)
def src_ragged(spark, sf_dir):
    """Odd rows lack the second field; even rows have one field too many."""
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(",", key, "c_name", F.lit("extra"))).otherwise(key)
    path = scratch_dir(spark) + "/data"
    # One column under a separator of its own, so that commas are written as they are.
    lines = table(spark, sf_dir, "customer").select(line.alias("id,name"))
    lines.write.options(header=True, sep="\u0001").csv(path)
    return csv.read_csv(spark, path)


PARTIES = (
    "SELECT c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment, '' AS code FROM customer"
    " UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR), '', 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier"
)


def _party_files(spark, sf_dir) -> list[str]:
    """Customers and suppliers as exports with differing headers; paths in input order."""
    base = scratch_dir(spark)
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_name").alias("name"),
    )
    sinks.write_csv(customer, base + "/customer")
    sinks.write_csv(supplier, base + "/supplier")
    return [base + "/customer", base + "/supplier"]


@query(PARTIES)
def src_multi(spark, sf_dir):
    paths = discover(spark, _party_files(spark, sf_dir))
    return csv.read_many(spark, paths).df.drop("_file_ord", "_row_ord")


# Bytes of the lines that each folder's files hold, without their headers.
_CUSTOMER_BYTES = "sum(strlen(c_name) + strlen(CAST(c_nationkey AS VARCHAR)) + strlen(c_mktsegment) + 3)"
_SUPPLIER_BYTES = "sum(strlen(s_name) + strlen(CAST(s_nationkey AS VARCHAR)) + strlen(CAST(s_suppkey AS VARCHAR)) + 4)"
INVENTORY = (
    f"SELECT 'customer' AS folder, 'name,nation,segment' AS header, 3 AS columns, count(*) AS rows, CAST({_CUSTOMER_BYTES} AS BIGINT) AS bytes FROM customer"
    f" UNION ALL SELECT 'supplier', 'code,nation,name', 3, count(*), CAST({_SUPPLIER_BYTES} AS BIGINT) FROM supplier"
)


def _folder(path):
    return F.element_at(F.split(path, "/"), -2)


@query(
    "SELECT 'customer' AS folder, 'name,nation,segment' AS header, count(*) AS rows FROM customer"
    " UNION ALL SELECT 'supplier', 'code,nation,name', count(*) FROM supplier"
)
def src_header_scan(spark, sf_dir):
    """Rows per folder and header: the headers of all files, and the rows of each file by its ordinal."""
    loaded = csv.read_many(spark, discover(spark, _party_files(spark, sf_dir)))
    named = [(f.ord, f.path, ",".join(f.header)) for f in loaded.files]
    heads = spark.createDataFrame(named, "_file_ord int, path string, header string")
    counted = loaded.df.groupBy("_file_ord").agg(F.count(F.lit(1)).alias("rows")).join(heads, "_file_ord")
    return counted.groupBy(_folder(F.col("path")).alias("folder"), "header").agg(F.sum("rows").alias("rows"))


@query(INVENTORY)
def src_file_inventory(spark, sf_dir):
    """Rows, columns and bytes per folder; a header with its line end is taken off each file."""
    loaded = csv.read_many(spark, discover(spark, _party_files(spark, sf_dir)))
    heads = spark.createDataFrame([(f.path, ",".join(f.header)) for f in loaded.files], "path string, header string")
    body = F.col("bytes") - F.length("header") - 1
    inventory = csv.file_inventory(loaded).join(heads, "path").filter("columns > 0")
    return inventory.groupBy(_folder(F.col("path")).alias("folder"), "header", "columns").agg(
        F.sum("rows").alias("rows"), F.sum(body).alias("bytes")
    )


@query(
    "SELECT 'read' AS fate, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS rows"
    " UNION ALL SELECT 'given before', count(*) FROM customer UNION ALL SELECT 'matches nothing', 0"
)
def src_input_fates(spark, sf_dir):
    """Rows of the files by what became of their input: folders, a glob into one of them, a path that is not there."""
    folders = _party_files(spark, sf_dir)
    found = find_files(spark, [*folders, folders[0] + "/*.csv", folders[0] + "-gone"])
    loaded = csv.read_many(spark, found.paths)
    counted = csv.file_inventory(loaded).select("path", "rows")
    fates = found.frame(spark).join(counted, "path", "left")
    return fates.groupBy("fate").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


@query(PARTIES)
def union_same_files(spark, sf_dir):
    """Each folder given twice, and by two spellings of its path."""
    folders = _party_files(spark, sf_dir)
    paths = discover(spark, [*folders, *folders, folders[1].replace("/supplier", "/./supplier")])
    return csv.read_many(spark, paths).df.drop("_file_ord", "_row_ord")


@query(PARTIES)
def src_discover(spark, sf_dir):
    """Both folders found from the one above them; no file is taken twice."""
    above = _party_files(spark, sf_dir)[0].rsplit("/", 1)[0]
    paths = discover(spark, [above, above + "/customer/*.csv"], recursive=True)
    return csv.read_many(spark, paths).df.drop("_file_ord", "_row_ord")


@query(PARTIES)
def src_empty_file(spark, sf_dir):
    """Files without a line add neither rows nor columns."""
    folders = _party_files(spark, sf_dir)
    nothing = folders[0].rsplit("/", 1)[0] + "/nothing"
    table(spark, sf_dir, "customer").filter("c_custkey < 0").select("c_name").write.text(nothing)
    found = discover(spark, folders) + discover(spark, nothing, pattern="*.txt")
    return csv.read_many(spark, found).df.drop("_file_ord", "_row_ord")


@query(PARTIES)
def src_skip_bad(spark, sf_dir):
    """A path that does not exist is reported and left out."""
    paths = discover(spark, _party_files(spark, sf_dir))
    loaded = csv.read_many(spark, [paths[0] + ".gone", *paths], on_error="skip")
    return loaded.df.drop("_file_ord", "_row_ord")


@query(
    "SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(min(o_orderkey) AS VARCHAR) AS first,"
    " CAST(max(o_orderkey) AS VARCHAR) AS last FROM orders GROUP BY 1"
)
def src_row_ord(spark, sf_dir):
    """First and last order of each customer by the ordinals of a sorted export."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    path = _written(spark, in_input_order(orders, ["o_orderkey"]))
    df = csv.read_many(spark, discover(spark, path)).df
    place = F.struct("_file_ord", "_row_ord")
    return df.groupBy("o_custkey").agg(
        F.min_by("o_orderkey", place).alias("first"), F.max_by("o_orderkey", place).alias("last")
    )


@query(
    "SELECT min(o_orderkey) AS key, o_custkey AS customer FROM orders GROUP BY o_custkey"
)
def collate_files(spark, sf_dir):
    """Sorted orders as files; the first order of each customer is kept."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("ResponseID"))
    path = _written(spark, in_input_order(orders, ["o_orderkey"]))
    kept = collate(spark, path).df
    return kept.select(F.col("o_orderkey").cast("bigint").alias("key"), F.col("ResponseID").cast("bigint").alias("customer"))


@query(DOCUMENTS)
def sink_csv(spark, sf_dir):
    return csv.read_csv(spark, _written(spark, _documents(spark, sf_dir)), trim=False)


@query(DOCUMENTS)
def sink_csv_gz(spark, sf_dir):
    return csv.read_csv(spark, _written(spark, _documents(spark, sf_dir), ".csv.gz"), trim=False)


@query(ORDERS)
def sink_dated(spark, sf_dir):
    path = sinks.dated_path(scratch_dir(spark) + "/data.csv", "2024-01-30")
    sinks.write_csv(_orders(spark, sf_dir), path)
    return csv.read_csv(spark, path.replace("data.csv", "data_2024-01-30.csv"))


@query(with_(SURVEY) + "SELECT * EXCLUDE (_row_ord) FROM survey")
def sink_raw_dump(spark, sf_dir):
    return csv.read_csv(spark, _written(spark, survey(spark, sf_dir)))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def sink_parquet(spark, sf_dir):
    path = scratch_dir(spark) + "/data"
    sinks.write_parquet(table(spark, sf_dir, "documents"), path, ["lang"])
    return spark.read.parquet(path)


@query(TRANSCRIPTS)
def sink_transcripts(spark, sf_dir):
    path = scratch_dir(spark) + "/data"
    sinks.write_transcripts(_talk(spark, sf_dir), path)
    return csv.read_csv(spark, path, trim=False)


@query(with_(SURVEY, MARKED) + "SELECT * EXCLUDE (_row_ord, rn, n, first_ord) FROM marked WHERE rn = 1")
def sink_cleaned(spark, sf_dir):
    path = scratch_dir(spark) + "/data"
    sinks.write_cleaned(survey(spark, sf_dir), path, ORDER)
    return csv.read_csv(spark, path)


def _report_sql(part: str, totals: str, total: str, daily: str, days: list[str]) -> str:
    cells = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN day = '{d}' THEN n END), 0) AS VARCHAR) AS \"{d}\"" for d in days
    )
    return (
        f"SELECT '{part}' AS part, ParticipantID, CAST(any_value({total}) AS VARCHAR) AS total, {cells}"
        f" FROM {totals} JOIN {daily} USING (ParticipantID) GROUP BY ParticipantID"
    )


def _both_sql(days: list[str]) -> str:
    main = _report_sql("summary", "totals", "TotalEntries", "daily", days)
    audio = _report_sql("audio", "audio_totals", "TotalTextAudio", "audio_daily", days)
    return with_(SURVEY, DAILY, TOTALS, AUDIO_DAILY, AUDIO_TOTALS) + f"{main} UNION ALL {audio}"


def _both_parts(spark, path) -> DataFrame:
    """The two sections of a report, read back."""
    parts = []
    for part, total in (("summary", "TotalEntries"), ("audio", "TotalTextAudio")):
        rows = csv.read_csv(spark, f"{path}/{part}").withColumnRenamed(total, "total")
        parts.append(rows.withColumn("part", F.lit(part)))
    return parts[0].unionByName(parts[1])


@query(_both_sql(DAYS))
def sink_participation_report(spark, sf_dir):
    done, path = _analysis(spark, sf_dir, with_audio=True), scratch_dir(spark) + "/report"
    sinks.write_report(done.summary(), done.audio(), path)
    return _both_parts(spark, path)


@query(_both_sql(DAYS_INSIDE))
def sink_30day_report(spark, sf_dir):
    df, path = survey(spark, sf_dir), scratch_dir(spark) + "/report"
    sinks.write_report(p.summary_30day(df, ANCHOR_INSIDE), p.audio_30day(df, ANCHOR_INSIDE), path)
    return _both_parts(spark, path)

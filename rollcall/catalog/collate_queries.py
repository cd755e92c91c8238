"""Stacking, one row per key, and related counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.catalog.registry import query
from rollcall.catalog.survey_view import ORDER, SURVEY, survey, table, with_
from rollcall.operators import dedup as d
from rollcall.operators import rows as r
from rollcall.operators.sets import column_union as names
from rollcall.operators.sets import union_all
from rollcall.plans.collate import collate_tables


def _parties(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Customers and suppliers as two exports that share some columns."""
    customer = table(spark, sf_dir, "customer").select(
        F.lit(0).alias("_file_ord"),
        F.col("c_custkey").alias("_row_ord"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("string").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.lit(1).alias("_file_ord"),
        F.col("s_suppkey").alias("_row_ord"),
        F.col("s_nationkey").cast("string").alias("nationkey"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("acctbal"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"),
    )
    return [customer, supplier]


PARTIES = """
parties AS (
  SELECT 0 AS _file_ord, c_custkey AS _row_ord, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nationkey,
    c_acctbal AS acctbal, c_mktsegment AS segment, '' AS code FROM customer
  UNION ALL
  SELECT 1, s_suppkey, s_name, CAST(s_nationkey AS VARCHAR), s_acctbal, '', 'S' || CAST(s_suppkey AS VARCHAR)
  FROM supplier)"""


@query(with_(PARTIES) + "SELECT * FROM parties")
def union_by_name(spark, sf_dir):
    return union_all(_parties(spark, sf_dir))


def _ranked(source: str, keys: str, order: str) -> str:
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn"
        f" FROM {source}) WHERE rn = 1"
    )


@query(with_(PARTIES) + _ranked("parties", "nationkey, segment", "_file_ord, _row_ord"))
def collate(spark, sf_dir):
    keys, order = ["nationkey", "segment"], ["_file_ord", "_row_ord"]
    return collate_tables(_parties(spark, sf_dir), keys, order).df


@query(with_(SURVEY) + _ranked("survey", "ResponseID", "_row_ord"))
def dedup_first(spark, sf_dir):
    return d.dedup(survey(spark, sf_dir), order_by=ORDER)


@query(with_(SURVEY) + _ranked("survey", "ResponseID", "_row_ord DESC"))
def dedup_last(spark, sf_dir):
    return d.dedup(survey(spark, sf_dir), order_by=ORDER, keep="last")


@query(
    with_(SURVEY)
    + "SELECT * FROM survey WHERE Response = '' UNION ALL "
    + _ranked("(SELECT * FROM survey WHERE Response <> '')", "Response", "_row_ord")
)
def dedup_keep_empty(spark, sf_dir):
    return d.dedup(survey(spark, sf_dir), ["Response"], ORDER, empty_keys="keep")


@query("SELECT min(doc_id) AS doc_id, text, lang, source, n_chars FROM documents GROUP BY ALL")
def dedup_all_columns(spark, sf_dir):
    return d.dedup(table(spark, sf_dir, "documents"), None, ["doc_id"])


@query(
    with_(SURVEY)
    + "SELECT count(*) AS rows_before, count(*) - count(DISTINCT ResponseID) AS rows_removed,"
    " count(DISTINCT ResponseID) AS rows_after FROM survey"
)
def stats_dedup(spark, sf_dir):
    return d.dedup_stats(survey(spark, sf_dir))


@query(
    with_(SURVEY)
    + "SELECT count(*) AS totalRows, count(DISTINCT ResponseID) AS uniqueResponseIds,"
    " count(*) - count(DISTINCT ResponseID) AS duplicateResponseIds,"
    " count(*) FILTER (ResponseID = '') AS emptyResponseIds,"
    " (SELECT string_agg(ResponseID, ',' ORDER BY o) FROM (SELECT ResponseID, min(_row_ord) AS o FROM survey"
    " GROUP BY 1 ORDER BY o LIMIT 10)) AS sampleResponseIds FROM survey"
)
def stats_response_id(spark, sf_dir):
    stats = d.id_stats(survey(spark, sf_dir), order_by=ORDER)
    return stats.withColumn("sampleResponseIds", F.array_join("sampleResponseIds", ","))


@query(
    with_(PARTIES)
    + "SELECT _file_ord, count(*) AS rows, count(DISTINCT nationkey) AS unique_ids,"
    " count(*) - count(DISTINCT nationkey) AS duplicate_ids FROM parties GROUP BY 1"
)
def stats_unique_per_file(spark, sf_dir):
    return d.id_stats_by_file(union_all(_parties(spark, sf_dir)), "nationkey")


@query(with_(SURVEY) + "SELECT count(*) AS rows FROM survey")
def agg_row_totals(spark, sf_dir):
    return r.row_total(survey(spark, sf_dir))


@query(with_(SURVEY) + "SELECT * FROM survey ORDER BY _row_ord LIMIT 100")
def lim_preview(spark, sf_dir):
    return r.preview(survey(spark, sf_dir), 100, ORDER)


@query(
    with_(SURVEY)
    + "SELECT ResponseID FROM (SELECT ResponseID, min(_row_ord) AS o FROM survey GROUP BY 1) ORDER BY o LIMIT 10"
)
def lim_sample_ids(spark, sf_dir):
    return d.sample_ids(survey(spark, sf_dir), order_by=ORDER)


@query(with_(SURVEY) + "SELECT *, row_number() OVER (ORDER BY _row_ord) - 1 AS position FROM survey")
def ord_input(spark, sf_dir):
    return r.numbered(r.in_input_order(survey(spark, sf_dir), ORDER))


@query(with_(PARTIES) + "SELECT '_file_ord,_row_ord,name,nationkey,acctbal,segment,code' AS columns, count(*) AS rows FROM parties")
def column_union(spark, sf_dir):
    """Names of the stacked table's columns, each where it is first seen, and its rows."""
    frames = _parties(spark, sf_dir)
    return union_all(frames).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(",".join(names(frames))).alias("columns"), "rows")


@query(with_(SURVEY) + "SELECT ParticipantID, min(_row_ord) AS first_ord FROM survey GROUP BY 1")
def win_first_seen(spark, sf_dir):
    return r.first_seen(survey(spark, sf_dir), "ParticipantID", ORDER)


@query(with_(SURVEY) + "SELECT *, '' AS Wave FROM survey")
def prj_default_columns(spark, sf_dir):
    return r.ensure_columns(survey(spark, sf_dir), ["ResponseID", "Wave"])


@query(with_(SURVEY) + "SELECT PromptID, ResponseID, * EXCLUDE (PromptID, ResponseID) FROM survey")
def prj_key_first_order(spark, sf_dir):
    return r.keys_first(survey(spark, sf_dir), ["PromptID", "ResponseID"])

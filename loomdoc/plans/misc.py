"""Predicates, coercions, dates and JSON on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.functions import values
from loomdoc.plans.registry import query
from loomdoc.tables import load


@query(
    "tri_state_filter",
    """
WITH f AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS updated, CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS hide FROM pages)
SELECT page_id FROM f WHERE updated IS DISTINCT FROM false AND NOT coalesce(hide, false)""",
)
def tri_state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda n: F.when(F.col("page_id") % n == 0, True).when(F.col("page_id") % n == 1, False)
    return load(spark, sf_dir, "pages").filter(values.shown(flag(3), flag(5))).select("page_id")


@query(
    "half_split",
    """
SELECT c_custkey, CAST(ntile(2) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS BIGINT) AS half FROM customer""",
)
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.ntile(2).over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")).cast("long")
    return load(spark, sf_dir, "customer").select("c_custkey", half.alias("half"))


@query(
    "years_since",
    "SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2024-01-01') - floor(epoch(o_orderdate))) / 31557600.0) AS BIGINT) AS years FROM orders",
)
def years_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return load(spark, sf_dir, "orders").select("o_orderkey", values.years_between(F.col("o_orderdate"), now).alias("years"))


@query(
    "date_labels",
    """SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS day, strftime(o_orderdate, '%b %Y') AS month FROM orders""",
)
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", values.short_date(date).alias("day"), F.date_format(date, "MMM yyyy").alias("month"))


@query(
    "props_json",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events""",
)
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = values.json_or_empty(F.col("props"), "map<string, string>")
    return load(spark, sf_dir, "events").select(
        "event_id", F.coalesce(F.try_element_at(props, F.lit("k")).try_cast("long"), F.lit(-1).cast("long")).alias("k")
    )


@query(
    "safe_default",
    """
WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_name ELSE '' END AS v FROM part)
SELECT p_partkey, CASE WHEN v IS NULL THEN 'default' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN v ELSE '''' || v || '''' END AS shown FROM v""",
)
def safe_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.col("p_name")).otherwise("")
    return load(spark, sf_dir, "part").select("p_partkey", values.default_literal(v).alias("shown"))


@query(
    "title_case_labels",
    """
WITH w AS (SELECT p_partkey, replace(p_name, ' ', '-') AS name FROM part)
SELECT p_partkey, CASE WHEN name = 'red-ring' THEN 'The Ring' ELSE
  array_to_string(list_transform(string_split(name, '-'), lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS label FROM w""",
)
def title_case_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    return load(spark, sf_dir, "part").select("p_partkey", values.menu_label(name, {"red-ring": "The Ring"}).alias("label"))


@query(
    "release_status",
    """
WITH r AS (SELECT p_partkey AS ord, CASE p_size % 5 WHEN 0 THEN 'development' WHEN 1 THEN 'beta' WHEN 2 THEN 'stable' WHEN 3 THEN 'lts' ELSE 'eol' END AS status, p_brand AS series FROM part)
SELECT status, CAST(count(*) AS BIGINT) AS n, arg_min(series, ord) AS first_series FROM r WHERE status <> 'eol' GROUP BY status""",
)
def release_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["development", "beta", "stable", "lts", "eol"]
    status = F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % 5 + 1).cast("int"))
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), status.alias("status"), F.col("p_brand").alias("series"))
    return values.first_by_status(rows, [n for n in names if n != "eol"])


@query(
    "logo_summary",
    """
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS failed,
  CAST(count(*) FILTER (WHERE toxic IS NULL) AS BIGINT) AS skipped
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def logo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("failed"), F.count_if(F.col("toxic").isNull()).alias("skipped")
    )


@query(
    "sidebar_json",
    """
WITH e AS (SELECT DISTINCT p_brand AS slug, p_type AS label FROM part)
SELECT slug, '[' || string_agg('{"label":"' || label || '","slug":"' || slug || '/' || lower(label) || '"}', ',' ORDER BY label) || ']' AS items
FROM e GROUP BY slug""",
)
def sidebar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.col("p_brand").alias("slug"), F.col("p_type").alias("label")).distinct()
    return values.menu_json(rows, F.concat("slug", F.lit("/"), F.lower("label")))

"""Index, link and menu queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import index as op
from loomdoc.operators import lines
from loomdoc.plans.registry import query
from loomdoc.tables import load


@query(
    "index_upsert",
    """
WITH o AS (SELECT doc_id AS page, lang AS ref, source AS id FROM documents), n AS (SELECT doc_id AS page, 'q' || quality AS ref, 't' || toxic AS id FROM labels)
SELECT * FROM o WHERE page NOT IN (SELECT page FROM n) UNION ALL SELECT * FROM n""",
)
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("lang").alias("ref"), F.col("source").alias("id"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    new = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("page"), text("q", "quality").alias("ref"), text("t", "toxic").alias("id"))
    return op.upsert_pages(old, new, ["page"])


@query(
    "priority_merge",
    """
WITH s AS (SELECT item_id AS k, 'item' AS v, 0 AS p FROM benchmark UNION ALL SELECT doc_id, 'q' || quality, 1 FROM labels
  UNION ALL SELECT doc_id, lang, 2 FROM documents)
SELECT k, arg_min(v, p) AS v FROM s GROUP BY k""",
)
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.lit("item").alias("v"))
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("v"))
    documents = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("v"))
    return op.first_by_priority([items, labels, documents], "k", "v")


REFS_SQL = """
links AS (SELECT l_orderkey, l_linenumber, l_returnflag AS section, 'v' || (l_suppkey % 5) AS slug, 'p' || (l_partkey % 50) AS page,
  'toc' || (l_linenumber % 9) AS ref FROM lineitem),
idx AS (SELECT DISTINCT l_returnflag AS section, 'v' || (l_suppkey % 5) AS slug, 'p' || (l_partkey % 40) AS page,
  'toc' || (l_linenumber % 3) AS ref, 'id_' || (l_linenumber % 3) AS id FROM lineitem WHERE l_linestatus = 'O')"""


@query(
    "resolve_refs",
    f"""WITH {REFS_SQL}, known AS (SELECT DISTINCT section, slug, page FROM idx)
SELECT l_orderkey, l_linenumber,
  CASE WHEN i.id IS NOT NULL THEN i.id WHEN k.page IS NOT NULL AND regexp_matches(l.ref, '^toc[0-9]+$') THEN NULL ELSE l.ref END AS ref,
  CASE WHEN i.id = l.ref THEN 'same' WHEN i.id IS NOT NULL THEN 'resolved' WHEN k.page IS NOT NULL THEN 'dropped' ELSE 'kept' END AS state
FROM links l LEFT JOIN idx i USING (section, slug, page, ref) LEFT JOIN known k USING (section, slug, page)""",
)
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    cut = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    section, slug = F.col("l_returnflag").alias("section"), cut("v", "l_suppkey", 5).alias("slug")
    links = items.select("l_orderkey", "l_linenumber", section, slug, cut("p", "l_partkey", 50).alias("page"), cut("toc", "l_linenumber", 9).alias("ref"))
    table = items.filter("l_linestatus = 'O'").select(
        section, slug, cut("p", "l_partkey", 40).alias("page"), cut("toc", "l_linenumber", 3).alias("ref"), cut("id_", "l_linenumber", 3).alias("id")
    )
    return op.resolve_refs(links, table.distinct()).select("l_orderkey", "l_linenumber", "ref", "state")


@query(
    "resolve_positions",
    """
WITH headings AS (SELECT o_orderpriority AS route, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n, 'h' || o_orderkey AS id FROM orders),
links AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '9-NONE' ELSE (SELECT min(o_orderpriority) FROM orders) END AS route, CAST(event_id % 700 + 1 AS BIGINT) AS n FROM events),
sizes AS (SELECT route, count(*) AS c FROM headings GROUP BY route)
SELECT event_id, h.id, CASE WHEN h.id IS NOT NULL THEN 'resolved' WHEN c IS NOT NULL THEN 'dropped' ELSE 'kept' END AS state
FROM links LEFT JOIN headings h USING (route, n) LEFT JOIN sizes USING (route)""",
)
def resolve_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    headings = orders.select(
        F.col("o_orderpriority").alias("route"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("id")
    )
    headings = lines.numbered(headings, "route", "pos", F.floor(F.col("pos") / 10_000), "n")
    least = orders.agg(F.min("o_orderpriority").alias("least"))
    route = F.when(F.col("event_type") == "error", "9-NONE").otherwise(F.col("least"))
    links = load(spark, sf_dir, "events").join(F.broadcast(least)).select("event_id", route.alias("route"), (F.col("event_id") % 700 + 1).alias("n"))
    return op.resolve_positions(links, headings).select("event_id", "id", "state")


@query(
    "page_routes",
    """
WITH keys AS (SELECT c_custkey, 'k' || (c_custkey % 200) AS key FROM customer),
a AS (SELECT 'k' || n_nationkey AS key, '/manual/' || n_nationkey AS route FROM nation),
b AS (SELECT 'k' || s_suppkey AS key, '/module/' || s_suppkey AS route FROM supplier)
SELECT c_custkey, coalesce(a.route, b.route, 'https://wiki/' || key) AS route,
  CASE WHEN a.route IS NOT NULL THEN 'manual' WHEN b.route IS NOT NULL THEN 'module' ELSE 'external' END AS via
FROM keys LEFT JOIN a USING (key) LEFT JOIN b USING (key)""",
)
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    keys = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("k"), (F.col("c_custkey") % 200).cast("string")).alias("key"))
    manual = load(spark, sf_dir, "nation").select(text("k", "n_nationkey").alias("key"), text("/manual/", "n_nationkey").alias("route"))
    module = load(spark, sf_dir, "supplier").select(text("k", "s_suppkey").alias("key"), text("/module/", "s_suppkey").alias("route"))
    out = op.route_of(keys, [("manual", manual), ("module", module)], F.concat(F.lit("https://wiki/"), "key"))
    return out.select("c_custkey", "route", "via")


@query(
    "duplicate_label_ambiguity",
    """
WITH l AS (SELECT source, lang || n_chars AS label, doc_id AS id FROM documents)
SELECT source, label, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM l GROUP BY source, label""",
)
def duplicate_label_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("lang", F.col("n_chars").cast("string")).alias("label")
    labels = load(spark, sf_dir, "documents").select("source", label, F.col("doc_id").alias("id"))
    return op.unambiguous(labels, ["source", "label"], "id")


@query(
    "menu_grouping",
    """
WITH links AS (SELECT p_brand AS grp, min(p_partkey) AS pos, p_name AS page FROM part WHERE p_size < 25 GROUP BY p_brand, p_name),
existing AS (SELECT DISTINCT p_name AS page FROM part WHERE p_retailprice > 905),
used AS (SELECT grp, pos, page FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS k FROM links WHERE page IN (SELECT page FROM existing)) WHERE k = 1)
SELECT * FROM used UNION ALL
SELECT 'Other', CAST(row_number() OVER (ORDER BY page) AS BIGINT), page FROM existing WHERE page NOT IN (SELECT page FROM links)""",
)
def menu_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    links = part.filter("p_size < 25").groupBy(F.col("p_brand").alias("grp"), F.col("p_name").alias("page")).agg(F.min("p_partkey").alias("pos"))
    existing = part.filter("p_retailprice > 905").select(F.col("p_name").alias("page")).distinct()
    return op.grouped_entries(links, existing).select("grp", "pos", "page")


@query(
    "first_seen_pages",
    "SELECT user_id, event_type, CAST(min(event_id) AS BIGINT) AS pos FROM events GROUP BY user_id, event_type",
)
def first_seen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("pos", F.col("event_id"))
    return op.first_seen(rows, "user_id", "event_type")


@query(
    "check_summary",
    """
WITH b AS (SELECT doc_id AS key, text || '#toc1' AS body FROM documents),
n AS (SELECT doc_id AS key, CASE doc_id % 4 WHEN 0 THEN text || '#toc1' WHEN 1 THEN text || '#toc22' ELSE text || '!' END AS body FROM documents WHERE doc_id % 4 <> 3),
c AS (SELECT CASE WHEN n.body IS NULL THEN 'nosource' WHEN n.body = b.body THEN 'unchanged'
  WHEN regexp_replace(n.body, '#toc[0-9]+', '#', 'g') = regexp_replace(b.body, '#toc[0-9]+', '#', 'g') THEN 'toc-only' ELSE 'changed' END AS kind
  FROM b LEFT JOIN n USING (key))
SELECT kind, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY kind""",
)
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, k = load(spark, sf_dir, "documents"), F.col("doc_id") % 4
    tail = F.when(k == 0, "#toc1").when(k == 1, "#toc22").otherwise("!")
    before = documents.select(F.col("doc_id").alias("key"), F.concat("text", F.lit("#toc1")).alias("body"))
    now = documents.filter(k != 3).select(F.col("doc_id").alias("key"), F.concat("text", tail).alias("body"))
    return op.compared(now, before).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

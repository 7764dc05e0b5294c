"""Version queries: part types are pages, brands are versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import versions as op
from loomdoc.plans.registry import query
from loomdoc.tables import load

MODEL_SQL = """
pages AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS ord, p_type || '-' || p_size AS page FROM part),
versions AS (SELECT DISTINCT ord FROM pages),
gaps AS (
  SELECT v.ord, p.page FROM (SELECT DISTINCT page FROM pages) p CROSS JOIN versions v
  EXCEPT SELECT ord, page FROM pages)"""


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = load(spark, sf_dir, "part")
    page = F.concat("p_type", F.lit("-"), F.col("p_size").cast("string"))
    pages = part.select(F.substring("p_brand", 7, 10).cast("long").alias("ord"), page.alias("page")).distinct()
    return pages, pages.select("ord").distinct()


@query("page_union", "SELECT DISTINCT p_type || '-' || p_size AS page FROM part")
def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page_union(model(spark, sf_dir)[0])


@query("missing_pairs", f"WITH {MODEL_SQL} SELECT ord, page FROM gaps WHERE page <> 'ECONOMY-1'")
def missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.missing_pairs(*model(spark, sf_dir), exclude=["ECONOMY-1"])


NEAREST_SQL = f"""{MODEL_SQL},
nearest AS (
  SELECT g.ord, g.page, arg_min(p.ord, abs(g.ord - p.ord) * 1000 + p.ord) AS nearest
  FROM gaps g JOIN pages p USING (page) GROUP BY g.ord, g.page)"""


@query("nearest_version", f"WITH {NEAREST_SQL} SELECT ord, page, nearest FROM nearest")
def nearest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.nearest_version(*model(spark, sf_dir))


def _stub_sql() -> str:
    head, rest = op.REDIRECT.replace("\n", "' || chr(10) || '").split("{title}")
    middle, end = rest.split("{target}")
    return f"'{head}' || page || '{middle}/v' || nearest || '/' || page || '/{end}'"


@query("redirect_stubs", f"WITH {NEAREST_SQL} SELECT ord, page, {_stub_sql()} AS body FROM nearest")
def redirect_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.nearest_version(*model(spark, sf_dir))
    target = op.page_url(F.concat(F.lit("v"), F.col("nearest").cast("string")), F.col("page"))
    return found.select("ord", "page", op.redirect_stub(F.col("page"), target).alias("body"))


@query(
    "availability_semi",
    """SELECT doc_id AS ord, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE NOT coalesce(toxic = 1, false))""",
)
def availability_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "lang")
    pages = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), (F.col("toxic") == 1).alias("hidden"))
    return op.available_versions(versions, pages)


@query(
    "nav_entries",
    """
WITH template AS (SELECT DISTINCT p_brand AS grp, p_size AS ord, p_type || '-' || p_size AS page FROM part),
there AS (SELECT DISTINCT p_type || '-' || p_size AS page FROM part WHERE p_retailprice < 950)
SELECT grp, string_agg(page, '|' ORDER BY ord, page) AS entries FROM template WHERE page IN (SELECT page FROM there) GROUP BY grp""",
)
def nav_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    page = F.concat("p_type", F.lit("-"), F.col("p_size").cast("string")).alias("page")
    template = part.select(F.col("p_brand").alias("grp"), F.col("p_size").alias("ord"), page).distinct()
    found = op.existing_entries(template, part.filter("p_retailprice < 950").select(page), "grp")
    return found.select("grp", F.array_join("entries", "|").alias("entries"))


@query(
    "version_routes",
    """
WITH v AS (SELECT DISTINCT CASE WHEN r_name = 'AFRICA' THEN 'master' ELSE r_name || '.' || r_regionkey END AS branch FROM region),
s AS (SELECT branch, CASE WHEN branch = 'master' THEN 'devel' ELSE replace(branch, '.', '-') END AS slug FROM v)
SELECT branch, slug, '/' || slug || '/' AS root, '/' || slug || '/intro/' AS intro FROM s""",
)
def version_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("r_name", F.lit("."), F.col("r_regionkey").cast("string"))
    branch = F.when(F.col("r_name") == "AFRICA", "master").otherwise(name)
    rows = load(spark, sf_dir, "region").select(branch.alias("branch")).distinct().withColumn("slug", op.version_slug(F.col("branch")))
    url = lambda p: op.page_url(F.col("slug"), F.lit(p))
    return rows.select("branch", "slug", url("index").alias("root"), url("intro").alias("intro"))


@query(
    "page_versions",
    """
WITH v AS (SELECT r_regionkey AS ord, lower(r_name) AS slug FROM region),
p AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second, p_size FROM part),
seen AS (
  SELECT CASE WHEN k % 3 = 0 THEN 'module' ELSE 'manual' END AS kind, CASE k % 3 WHEN 0 THEN first WHEN 1 THEN 'guide/' || second ELSE '' END AS page, v.ord, v.slug
  FROM p JOIN v ON v.ord = k % 6 WHERE k % 7 > 1 AND p_size < 40)
SELECT kind, page, string_agg(slug, ' ' ORDER BY ord) AS slugs FROM (SELECT DISTINCT * FROM seen) GROUP BY kind, page""",
)
def page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of modules, of manuals and their indexes; hidden ones, those of unlisted versions, of deeper folders and without a
    version tell of none."""
    versions = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ord"), F.lower("r_name").alias("slug"))
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    part = load(spark, sf_dir, "part").join(versions, k % 6 == F.col("ord"), "left")
    slug = F.coalesce("slug", F.lit("unlisted"))
    route = F.when(k % 3 == 0, F.concat(F.lit("docs/modules/"), slug, F.lit("/"), words[0])).when(k % 3 == 1, F.concat(F.lit("docs/manual/"), slug, F.lit("/guide/"), words[1]))
    route = route.otherwise(F.concat(F.lit("docs/manual/"), slug))
    other = F.when(k % 2 == 0, F.concat(F.lit("docs/modules/"), slug, F.lit("/deep/"), words[0])).otherwise(F.concat(F.lit("docs/"), words[0]))
    pages = part.select(F.when(k % 7 == 0, other).otherwise(route).alias("route"), F.when(k % 7 == 1, True).when(F.col("p_size") >= 40, True).alias("hidden"))
    return op.page_versions(pages, versions).select("kind", "page", F.array_join("slugs", " ").alias("slugs"))

"""HTML queries over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import anchors, html
from loomdoc.operators import contributors
from loomdoc.plans.registry import query
from loomdoc.tables import load


def _decoded(c: str) -> str:
    for entity, char in html.ENTITIES:
        c = f"replace({c}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


TEXT_SQL = (
    "trim(regexp_replace("
    + _decoded(
        "regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')"
    )
    + ", '[ \\t\\r\\n]+', ' ', 'g'))"
)
LINKS_SQL = """
found AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*"[^>]*>.*?</a>', 0, 's') AS parts FROM pages),
places AS (SELECT page_id, parts, unnest(range(len(parts))) AS k FROM found),
links AS (SELECT page_id, CAST(k AS INT) AS pos, regexp_extract(parts[k + 1], 'href="([^"]*)"', 1) AS href,
  trim(regexp_replace(parts[k + 1], '<[^>]*>', '', 'g')) AS label FROM places)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("pos", "link"))
    return rows.select("page_id", "pos", "link.href", "link.label")


@query("strip_html", f"SELECT page_id, {TEXT_SQL} AS body FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", html.strip_tags(F.col("html")).alias("body"))


@query("page_title", f"SELECT page_id, nullif({_decoded("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}, '') AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, pos, href, label FROM links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir)


@query("entity_decode", f"SELECT page_id, md5({_decoded('html')}) AS digest FROM pages")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.md5(html.decode_entities(F.col("html"))).alias("digest"))


@query("feed_teaser", f"SELECT page_id, left({TEXT_SQL}, 200) || '…' AS teaser FROM pages")
def feed_teaser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", html.teaser(html.strip_tags(F.col("html"))).alias("teaser"))


@query(
    "url_route",
    r"""
WITH r AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(\.html)?/?$', '') AS route FROM pages)
SELECT page_id, route, CAST(len(string_split(route, '/')) - 1 AS BIGINT) AS depth,
  CASE WHEN regexp_matches(url, '(?i)^[a-z]+://[^/?#]*/[^?#]*[^/?#]\.(svg|png|jpg|jpeg|webp)([?#]|$)')
    THEN '.' || lower(regexp_extract(url, '\.([A-Za-z]+)([?#]|$)', 1)) ELSE '.png' END AS ext,
  ['.svg', '.webp', '.jpg', '.jpg', '.png'][CAST(page_id % 5 AS INT) + 1] AS by_content
FROM r""",
)
def url_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").withColumn("route", html.route(F.col("url")))
    depth = (F.size(F.split("route", "/")) - 1).cast("long")
    kinds = F.array(*map(F.lit, ["image/svg+xml", "image/webp", "image/jpeg", "image/jpg", "text/html"]))
    content = F.get(kinds, (F.col("page_id") % 5).cast("int"))
    by_content = html.extension(F.concat("url", F.lit("/x.html")), content)
    return rows.select("page_id", "route", depth.alias("depth"), html.extension(F.col("url")).alias("ext"), by_content.alias("by_content"))


@query(
    "name_slugs",
    """
SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
  lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS anchor,
  replace(regexp_replace(lower(trim(regexp_replace(url, '[*_]{1,3}([^*_]+)[*_]{1,3}', '\\1', 'g'))), '[^a-z0-9 _-]', '', 'g'), ' ', '-') AS forge
FROM pages""",
)
def name_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return load(spark, sf_dir, "pages").select(
        "page_id", anchors.hyphen_slug(url).alias("slug"), anchors.underscore_slug(url).alias("anchor"), anchors.forge_slug(url).alias("forge")
    )


def _score_sql(address: str) -> str:
    parts = [f"CASE WHEN lower({address}) LIKE '%{end}' THEN {p} ELSE 0 END" for end, p in html.TYPE_POINTS.items()]
    for words, points in ((html.GOOD_WORDS, html.GOOD_POINTS), (html.BAD_WORDS, html.BAD_POINTS)):
        parts += [f"CASE WHEN contains(lower({address}), '{w}') THEN {points} ELSE 0 END" for w in words]
    return " + ".join(parts) + " + CASE pos % 3 WHEN 0 THEN 10 WHEN 1 THEN 15 ELSE least(length(label) / 10.0, 20.0) END"


@query(
    "candidate_score",
    f"""WITH {LINKS_SQL},
scored AS (SELECT page_id, pos, href, CAST({_score_sql("href")} AS DOUBLE) AS score FROM links)
SELECT page_id, href, score, CAST(rn AS BIGINT) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rn FROM scored) WHERE rn <= 3""",
)
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.get(F.array(*map(F.lit, ["apple-touch-icon", "img-src", "icon"])), F.col("pos") % 3)
    score = html.candidate_score(F.col("href"), F.concat(F.length("label"), F.lit("x1")), source).cast("double")
    rows = links(spark, sf_dir).withColumn("score", score)
    top = contributors.ranked(rows, "page_id", [F.desc("score"), F.asc("pos")]).filter("rn <= 3")
    return top.select("page_id", "href", "score", "rn")


@query(
    "link_stats",
    f"""WITH {LINKS_SQL}, routes AS (SELECT DISTINCT '/' || n_name AS route FROM nation UNION SELECT '/the' UNION SELECT '/and')
SELECT page_id, CAST(count(*) FILTER (WHERE href IN (SELECT route FROM routes)) AS BIGINT) AS resolved,
  CAST(count(*) FILTER (WHERE href NOT IN (SELECT route FROM routes)) AS BIGINT) AS dropped,
  CAST(count(DISTINCT href) FILTER (WHERE href NOT IN (SELECT route FROM routes)) AS BIGINT) AS missing
FROM links GROUP BY page_id""",
)
def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "nation").select(F.concat(F.lit("/"), "n_name").alias("route"))
    known = known.union(spark.createDataFrame([("/the",), ("/and",)], "route string")).distinct().withColumn("there", F.lit(True))
    rows = links(spark, sf_dir).join(known, F.col("href") == F.col("route"), "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return rows.groupBy("page_id").agg(
        F.count_if("there").alias("resolved"),
        F.count_if(~F.col("there")).alias("dropped"),
        F.count_distinct(F.when(~F.col("there"), F.col("href"))).alias("missing"),
    )


@query(
    "url_classes",
    r"""SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN regexp_matches(u, '/html/docs/modules/[^/]+/[^/]+\.html') THEN 'module'
    WHEN regexp_matches(u, '/Documentation/[A-Za-z-]+') THEN 'manual' ELSE 'other' END AS kind
  FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'https://x.org/html/docs/modules/1.x/m' || page_id || '.html'
    WHEN 1 THEN 'https://x.org/Documentation/Install-' || page_id ELSE url END AS u FROM pages)) GROUP BY kind""",
)
def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    made = (
        F.when(k == 0, F.concat(F.lit("https://x.org/html/docs/modules/1.x/m"), n, F.lit(".html")))
        .when(k == 1, F.concat(F.lit("https://x.org/Documentation/Install-"), n))
        .otherwise(F.col("url"))
    )
    rows = load(spark, sf_dir, "pages").select(html.url_class(made).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

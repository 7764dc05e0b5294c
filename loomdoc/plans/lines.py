"""Line and heading queries over documents: a line of fewer than 40 characters stands for a heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import anchors
from loomdoc.operators import lines as op
from loomdoc.plans.registry import query
from loomdoc.tables import load

#: Texts here are lines of a page; pages are bounded, so folds over a page's list are too.
LINES_SQL = """
pos AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, CAST(pos AS INT) AS pos, parts[pos + 1] AS line FROM pos)"""
SLUG_SQL = "lower(regexp_replace(regexp_replace(line, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lines_of(load(spark, sf_dir, "documents"), "doc_id", "text")


def level(line: Column) -> Column:
    return (F.length(line) % 4 + 2).cast("int")


@query(
    "line_ids",
    f"""WITH {LINES_SQL},
slugs AS (SELECT doc_id, pos, '#' || {SLUG_SQL} AS base FROM lines),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) AS k FROM slugs)
SELECT doc_id, pos, CASE WHEN k = 1 THEN base ELSE base || '-' || CAST(k - 1 AS VARCHAR) END AS id FROM numbered""",
)
def line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("base", F.concat(F.lit("#"), anchors.underscore_slug(F.col("line"))))
    lists = op.in_document_order(rows, "doc_id", "base", "bases")
    return lists.select("doc_id", F.posexplode(anchors.counted_hyphen(F.col("bases"))).alias("pos", "id"))


@query(
    "heading_ordinals",
    f"""WITH {LINES_SQL}
SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS n,
  'toc' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR) AS toc
FROM lines WHERE length(line) BETWEEN 1 AND 39""",
)
def heading_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.ordinals(lines(spark, sf_dir), "doc_id", F.length("line").between(1, 39))
    return rows.select("doc_id", "pos", "n", F.concat(F.lit("toc"), F.col("n").cast("string")).alias("toc"))


@query(
    "fence_parity",
    f"""WITH {LINES_SQL},
counted AS (SELECT *, line LIKE '% | %' AS fence, sum(CASE WHEN line LIKE '% | %' THEN 1 ELSE 0 END) OVER (
  PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM lines)
SELECT doc_id, pos, fence OR n % 2 = 1 AS in_fence FROM counted""",
)
def fence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fenced(lines(spark, sf_dir), "doc_id", F.col("line").contains(" | ")).select("doc_id", "pos", "in_fence")


@query(
    "blank_collapse",
    f"""WITH {LINES_SQL}, marked AS (SELECT doc_id, pos, CASE WHEN length(line) < 20 THEN '' ELSE line END AS line FROM lines),
seen AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM marked)
SELECT doc_id, pos, line FROM seen WHERE line <> '' OR before IS NULL OR before <> ''""",
)
def blank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("line", F.when(F.length("line") < 20, "").otherwise(F.col("line")))
    return op.collapse_blank(rows, "doc_id").select("doc_id", "pos", "line")


@query(
    "run_islands",
    """
WITH changed AS (
  SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS c FROM conversations)
SELECT conv_id, turn, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM changed""",
)
def run_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").withColumn("pos", F.col("turn"))
    return op.islands(rows, "conv_id", F.col("role")).select("conv_id", "turn", "island")


@query(
    "carry_down",
    """
SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events""",
)
def carry_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("pos", F.struct("ts", "event_id"))
    value = F.when(F.col("event_type") == "error", F.col("event_id"))
    return op.carried_down(rows, "user_id", "last_error", value).select("event_id", "last_error")


@query(
    "heading_context",
    f"""WITH {LINES_SQL}, h AS (SELECT doc_id, pos, CAST(length(line) % 4 + 2 AS INT) AS level, line AS text FROM lines WHERE length(line) > 0),
g AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM h)
SELECT doc_id, pos, level,
  md5(last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS guide,
  md5(last_value(CASE WHEN level = 3 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, grp ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS section
FROM g""",
)
def heading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).filter(F.length("line") > 0).select("doc_id", "pos", level(F.col("line")).alias("level"), F.col("line").alias("text"))
    return op.heading_context(rows, "doc_id").select("doc_id", "pos", "level", F.md5("guide").alias("guide"), F.md5("section").alias("section"))


@query(
    "heading_levels",
    f"""WITH RECURSIVE {LINES_SQL},
h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, CAST(length(line) % 4 + 2 AS INT) AS level FROM lines),
s AS (SELECT doc_id, n, level - min(level) OVER (PARTITION BY doc_id) + 2 AS level FROM h),
walk AS (
  SELECT doc_id, n, CAST(least(level, 2) AS INT) AS put FROM s WHERE n = 1
  UNION ALL SELECT s.doc_id, s.n, CAST(least(s.level, w.put + 1) AS INT) FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.n = w.n + 1)
SELECT doc_id, string_agg(CAST(put AS VARCHAR), ',' ORDER BY n) AS levels FROM walk GROUP BY doc_id""",
)
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "pos", level(F.col("line")).alias("level"))
    lists = op.in_document_order(rows, "doc_id", "level", "levels")
    return lists.select("doc_id", F.array_join(op.clamped_levels(F.col("levels")).cast("array<string>"), ",").alias("levels"))


@query(
    "look_ahead",
    f"""WITH {LINES_SQL}
SELECT doc_id, pos,
  md5(first_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS next_line,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) - 1, 0) AS BIGINT) AS n_ahead
FROM lines""",
)
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.next_filled(lines(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "pos", F.md5("next_line").alias("next_line"), F.length("ahead").cast("long").alias("n_ahead"))


@query(
    "first_paragraph",
    """
WITH p AS (SELECT doc_id, list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n[ \\t]*\\n'),
  lambda x: trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'))) AS parts FROM documents),
f AS (SELECT doc_id, list_filter(parts, lambda x: x <> '' AND NOT regexp_matches(x, '^([#*|>\\-+]|```)'))[1] AS first FROM p)
SELECT doc_id, CASE WHEN length(first) > 160 THEN substr(first, 1, 157) || '...' ELSE first END AS description FROM f""",
)
def first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return load(spark, sf_dir, "documents").select("doc_id", op.first_paragraph(spaced, 160).alias("description"))


@query(
    "free_ids",
    f"""WITH RECURSIVE {LINES_SQL},
h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, left({SLUG_SQL}, 4) AS id FROM lines),
walk AS (
  SELECT doc_id, n, id AS put, [id] AS used FROM h WHERE n = 1
  UNION ALL
  SELECT x.doc_id, x.n, x.put, list_append(x.used, x.put) FROM (
    SELECT h.doc_id, h.n, w.used, CASE WHEN NOT list_contains(w.used, h.id) THEN h.id ELSE
      list_filter(list_transform(range(2, len(w.used) + 3), lambda k: h.id || '_' || CAST(k AS VARCHAR)), lambda c: NOT list_contains(w.used, c))[1] END AS put
    FROM walk w JOIN h ON h.doc_id = w.doc_id AND h.n = w.n + 1) x)
SELECT doc_id, md5(string_agg(put, ',' ORDER BY n)) AS ids FROM walk GROUP BY doc_id""",
)
def free_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("id", F.left(anchors.underscore_slug(F.col("line")), F.lit(4)))
    lists = op.in_document_order(rows, "doc_id", "id", "ids")
    return lists.select("doc_id", F.md5(F.array_join(anchors.free_underscore(F.col("ids")), ",")).alias("ids"))

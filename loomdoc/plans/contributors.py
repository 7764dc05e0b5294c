"""Contributor queries on the star schema: a priority is a module, a nation an author, an order a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import contributors as op
from loomdoc.plans.registry import query
from loomdoc.tables import load

COMMITS_SQL = """
lines AS (
  SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS added, sum(CAST(l_linenumber AS BIGINT)) AS deleted
  FROM lineitem GROUP BY l_orderkey),
commits AS (
  SELECT o_orderpriority AS module, n_name AS author, o_orderdate AS date, o_orderkey AS sha, added, deleted
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN lines ON l_orderkey = o_orderkey
  WHERE added > 0 OR deleted > 0),
stats AS (
  SELECT module, author, count(*) AS commits, sum(added) AS added, sum(deleted) AS deleted,
    min(date) AS first_date, max(date) AS last_date
  FROM commits GROUP BY module, author)"""

RANKED_SQL = f"""{COMMITS_SQL},
rates AS (
  SELECT sum(added) / CAST(count(*) AS DOUBLE) AS add_rate, sum(deleted) / CAST(count(*) AS DOUBLE) AS del_rate FROM commits),
scored AS (
  SELECT module, author, CAST(commits AS BIGINT) AS commits, CAST(added AS BIGINT) AS added,
    CAST(deleted AS BIGINT) AS deleted, first_date, last_date,
    CAST(commits + ceil(added / add_rate) + ceil(deleted / del_rate) AS BIGINT) AS score
  FROM stats, rates),
ranked AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY module ORDER BY score DESC, commits DESC, added DESC, author) AS BIGINT) AS rn
  FROM scored)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines: (module, author, date, sha, added, deleted)."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("added"),
        F.sum(F.col("l_linenumber").cast("long")).alias("deleted"),
    )
    joined = (
        load(spark, sf_dir, "orders")
        .join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    )
    return op.drop_empty_commits(
        joined.select(
            F.col("o_orderpriority").alias("module"),
            F.col("n_name").alias("author"),
            F.col("o_orderdate").alias("date"),
            F.col("o_orderkey").alias("sha"),
            "added",
            "deleted",
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author statistics with scores. The rates come from the statistics, so the commits are made once."""
    stats = op.author_stats(commits(spark, sf_dir), ["module", "author"])
    n = F.sum("commits")
    rates = stats.agg((F.sum("added") / n).alias("add_rate"), (F.sum("deleted") / n).alias("del_rate"))
    return op.with_score(stats, rates)


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ranked(scored(spark, sf_dir), "module", op.by_score())


@query(
    "contrib_leaderboard",
    f"""WITH {RANKED_SQL}
SELECT module, author, commits, added, deleted, score, rn FROM ranked WHERE rn <= {op.TABLE_SIZE}""",
)
def contrib_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leaderboard(spark, sf_dir).filter(F.col("rn") <= op.TABLE_SIZE)
    return rows.select("module", "author", "commits", "added", "deleted", "score", "rn")


@query(
    "contrib_activity",
    f"""WITH {COMMITS_SQL}
SELECT module, author, last_date, CAST(row_number() OVER (PARTITION BY module
  ORDER BY coalesce(CAST(floor(epoch(last_date)) AS BIGINT), 0) DESC, author) AS BIGINT) AS rn
FROM stats""",
)
def contrib_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = op.author_stats(commits(spark, sf_dir), ["module", "author"])
    return op.ranked(stats, "module", op.by_activity()).select("module", "author", "last_date", "rn")


@query(
    "contrib_overflow",
    f"""WITH {RANKED_SQL}
SELECT module, CAST(count(*) AS BIGINT) AS n_more, string_agg(author, ', ' ORDER BY rn) AS more
FROM ranked WHERE rn > {op.TABLE_SIZE} GROUP BY module""",
)
def contrib_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.overflow_line(leaderboard(spark, sf_dir), "module")


@query(
    "contrib_rows",
    f"""WITH {RANKED_SQL}
SELECT module, '| ' || CAST(rn AS VARCHAR) || '. | ' || author || ' | ' || CAST(score AS VARCHAR) || ' | ' ||
  CAST(commits AS VARCHAR) || ' | ' || strftime(first_date, '%b %Y') || ' - ' || strftime(last_date, '%b %Y') || ' |' AS line
FROM ranked WHERE rn <= {op.TABLE_SIZE}""",
)
def contrib_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leaderboard(spark, sf_dir).filter(F.col("rn") <= op.TABLE_SIZE)
    text = lambda c: F.col(c).cast("string")
    span = F.concat(op.month_label(F.col("first_date")), F.lit(" - "), op.month_label(F.col("last_date")))
    line = F.concat(
        F.lit("| "), text("rn"), F.lit(". | "), "author", F.lit(" | "), text("score"), F.lit(" | "), text("commits"), F.lit(" | "), span, F.lit(" |")
    )
    return rows.select("module", line.alias("line"))


@query(
    "doc_editors",
    f"""WITH {COMMITS_SQL}
SELECT module, string_agg(author, ', ' ORDER BY coalesce(CAST(floor(epoch(last_date)) AS BIGINT), 0) DESC, author) AS editors
FROM stats GROUP BY module""",
)
def doc_editors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.editors_line(op.author_stats(commits(spark, sf_dir), ["module", "author"]), "module")


@query(
    "author_canonical",
    """
WITH authors AS (SELECT c_custkey AS id, 'NATION_' || c_nationkey || ' <' || c_name || '>' AS raw, c_nationkey AS k FROM customer),
aliases AS (
  SELECT 'NATION_' || n_nationkey AS raw, n_name || '*' AS canonical FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 'NATION_' || c_nationkey || ' <' || c_name || '>', 'fixed ' || c_name FROM customer WHERE c_custkey % 10 = 0),
named AS (
  SELECT a.id, coalesce(f.canonical, n.canonical, trim(regexp_replace(a.raw, '\\s*<[^>]*>', '', 'g'))) AS author
  FROM authors a LEFT JOIN aliases f ON a.raw = f.raw
  LEFT JOIN aliases n ON trim(regexp_replace(a.raw, '\\s*<[^>]*>', '', 'g')) = n.raw),
handles AS (SELECT n_name || '*' AS name, 'h' || n_nationkey AS handle FROM nation WHERE n_nationkey % 4 = 0)
SELECT id, author, CASE WHEN starts_with(author, '@') OR handle IS NULL THEN author ELSE author || ' (@' || handle || ')' END AS shown
FROM named LEFT JOIN handles ON author = name""",
)
def author_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    raw = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit(" <"), "c_name", F.lit(">"))
    by_name = nation.filter("n_nationkey % 2 = 0").select(
        F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("raw"), F.concat("n_name", F.lit("*")).alias("canonical")
    )
    by_full = customer.filter("c_custkey % 10 = 0").select(raw.alias("raw"), F.concat(F.lit("fixed "), "c_name").alias("canonical"))
    handles = nation.filter("n_nationkey % 4 = 0").select(
        F.concat("n_name", F.lit("*")).alias("name"), F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("handle")
    )
    authors = customer.select(F.col("c_custkey").alias("id"), raw.alias("author"))
    return op.with_handle(op.canonical_author(authors, by_name.unionByName(by_full)), handles).select("id", "author", "shown")


@query(
    "skip_and_override",
    """
SELECT o_orderkey AS sha, coalesce('fixed ' || l.quality, o_orderpriority) AS author, o_orderdate AS date
FROM orders LEFT JOIN labels l ON o_orderkey = l.doc_id
WHERE o_orderkey NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def skip_and_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    rows = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("author"), F.col("o_orderdate").alias("date")
    )
    skipped = labels.filter("toxic = 1").select(F.col("doc_id").alias("sha"))
    fixed = labels.select(F.col("doc_id").alias("sha"), F.concat(F.lit("fixed "), F.col("quality").cast("string")).alias("fixed"))
    return op.with_overrides(op.without_skipped(rows, skipped), fixed).select("sha", "author", "date")


@query(
    "rename_bag_union",
    """
WITH c AS (SELECT p_brand AS module, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
renames AS (SELECT DISTINCT p_brand AS module, 'Brand#' || CAST(CAST(substr(p_brand, 7) AS INT) - 1 AS VARCHAR) AS old FROM part),
every AS (SELECT * FROM c UNION ALL SELECT r.module, l_quantity FROM c JOIN renames r ON c.module = r.old)
SELECT module, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM every GROUP BY module""",
)
def rename_bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    old = F.concat(F.lit("Brand#"), (F.substring("p_brand", 7, 10).cast("int") - 1).cast("string"))
    renames = part.select(F.col("p_brand").alias("module"), old.alias("old")).distinct()
    rows = load(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("module"), "l_quantity")
    return op.with_old_names(rows, renames).groupBy("module").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")
    )


@query(
    "numstat_rollup",
    """
SELECT l_returnflag AS module, l_orderkey AS sha, min(l_linestatus) AS author, min(l_shipdate) AS date,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS added, CAST(sum(coalesce(CASE WHEN l_linenumber > 1 THEN l_linenumber END, 0)) AS BIGINT) AS deleted
FROM lineitem GROUP BY l_returnflag, l_orderkey""",
)
def numstat_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("module"),
        F.col("l_orderkey").alias("sha"),
        F.col("l_linestatus").alias("author"),
        F.col("l_shipdate").alias("date"),
        F.col("l_quantity").cast("long").alias("added"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("deleted"),
    )
    return op.commits_from_numstat(files)

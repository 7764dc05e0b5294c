"""Files: pages and descriptions are written as trees from the driver's tables, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import schema_tables
from loomdoc.plans.cases import WORDS_SQL, filled, tasks, words
from loomdoc.plans.registry import query
from loomdoc.scratch import new_folder
from loomdoc.sources import page_tree, readers
from loomdoc.tables import load


@query(
    "page_files",
    f"""WITH {WORDS_SQL}, v AS (SELECT r_regionkey AS n, lower(r_name) AS version FROM region)
SELECT version, CASE WHEN p_partkey % 2 = 0 THEN 'sub/' ELSE '' END || 'p' || key || '.md' AS path, CASE WHEN n = 1 THEN 'new ' ELSE '' END || name AS text, 'near' AS root
FROM p JOIN v ON v.n = p_partkey % 5 WHERE n <> 4 AND (n <> 1 OR p_partkey % 3 <> 0)
UNION ALL SELECT version, 'far' || key || '.md', kind, 'far' FROM p JOIN v ON v.n = p_partkey % 5 WHERE n = 4
UNION ALL SELECT '', 'top' || key || '.md', CASE WHEN p_partkey % 3 = 1 THEN 'again ' ELSE '' END || name, 'near' FROM p WHERE p_partkey % 3 <> 2 AND p_partkey % 7 = 0""",
)
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of five versions and a top level, in which one version is replaced whole (it loses a third of its pages) and some
    files at the top are replaced or go; a version that the tree lacks comes from a second one."""
    near, far = new_folder(spark, "near"), new_folder(spark, "far")
    versions = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n"), F.lower("r_name").alias("version"))
    rows = words(spark, sf_dir).withColumn("n", F.col("p_partkey") % 5).join(versions, "n")
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "sub/").otherwise(""), filled("p«key».md"))
    pages = rows.select("n", "p_partkey", "version", path.alias("path"), F.col("name").alias("text"))
    page_tree.write_pages(pages.filter("n <> 4"), near)
    page_tree.write_pages(pages.filter("n = 1 AND p_partkey % 3 <> 0").withColumn("text", F.concat(F.lit("new "), "text")), near)
    page_tree.write_pages(rows.filter("n >= 3").select("version", filled("far«key».md").alias("path"), F.col("kind").alias("text")), far)
    top = rows.filter("p_partkey % 7 = 0").select("p_partkey", filled("top«key».md").alias("path"), F.col("name").alias("text"))
    page_tree.write_pages(top, near, flat=True)
    again = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("again "), "text"))
    page_tree.write_pages(top.filter("p_partkey % 3 > 0").withColumn("text", again), near, flat=True)
    names = [r["version"] for r in versions.collect()]  # the dimension of versions
    asked = [{"version": v, "roots": [near, far], "required": True} for v in names] + [{"version": "", "roots": [near]}]
    found = page_tree.read_pages(spark, asked, slices=-(-tasks(spark) // len(asked))).filter("error IS NULL")
    return found.select("version", "path", "text", F.when(F.col("root") == near, "near").otherwise("far").alias("root"))


@query(
    "schema_tree",
    """WITH v AS (SELECT DISTINCT p_type AS slug FROM part),
n AS (SELECT p_type AS slug, count(*) FILTER (WHERE p_partkey % 9 <> 0) AS there, count(*) FILTER (WHERE p_partkey % 9 = 0) AS lost FROM part GROUP BY p_type)
SELECT slug, CAST(there AS BIGINT) AS n_tables, CAST(lost AS BIGINT) AS n_missing, CAST(there AS BIGINT) AS n_sizes FROM v JOIN n USING (slug)""",
)
def schema_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of each version as files: a module, its tables (every ninth is not there) and the version's entities."""
    root = new_folder(spark, "schema")
    rows = words(spark, sf_dir)
    file = lambda rows, path, text: rows.select(F.col("kind").alias("version"), path.alias("path"), text.alias("text"))
    table = filled("<table><name>t«key»</name><column><name>c</name><type>int</type><size>&lng;</size></column></table>")
    refs = F.array_join(F.array_sort(F.collect_list(filled('<xi:include href="tables/t«key».xml"/>'))), "")
    module = rows.groupBy("kind").agg(refs.alias("refs"))
    kinds = rows.select("kind", F.length("kind").cast("string").alias("n")).distinct()
    every = file(rows.filter("p_partkey % 9 <> 0"), filled("tables/t«key».xml"), table)
    every = every.unionByName(file(module, F.lit("loom-all.xml"), filled("<m><name>«kind»</name>«refs»</m>")))
    every = every.unionByName(file(kinds, F.lit("entities.xml"), filled('<!ENTITY lng "size «n»">'))).unionByName(file(kinds, F.lit("readme.txt"), F.lit("x")))
    page_tree.write_pages(every, root)
    pages = schema_tables.schema_pages(*readers.schema_tree(spark, root, "loom"))
    sizes = F.size(F.split("body", r"\| size [0-9]+ \|", -1)) - 1
    return pages.select("slug", F.col("n_tables").cast("long").alias("n_tables"), F.col("n_missing").cast("long").alias("n_missing"), sizes.cast("long").alias("n_sizes"))


@query(
    "file_tables",
    f"""WITH {WORDS_SQL}
SELECT 'Group' || (p_partkey % 10) || '.Page' || key AS name, p_partkey % 2 = 0 AS hide, kind AS label FROM p WHERE p_partkey % 3 = 0""",
)
def file_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages among other files of a folder, by their names, with a table of JSON arrays beside them."""
    root = new_folder(spark, "wiki")
    rows = words(spark, sf_dir).withColumn("g", (F.col("p_partkey") % 10).cast("string"))
    name = F.when(F.col("p_partkey") % 3 == 0, filled("Group«g».Page«key»")).when(F.col("p_partkey") % 3 == 1, filled("p«key».py")).otherwise(filled("Group«g».Page«key».old"))
    page_tree.write_pages(rows.select(name.alias("path"), F.lit("text=x\n").alias("text")), f"{root}/pages", flat=True)
    hide = F.when(F.col("p_partkey") % 2 == 0, F.lit(',"hide":true')).otherwise("")
    entry = F.concat(filled('{"name":"Group«g».Page«key»","label":"«kind»"'), hide, F.lit("}"))
    sides = rows.groupBy("g").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(entry), ",\n"), F.lit("]")).alias("text"))
    page_tree.write_pages(sides.select(filled("side«g».json").alias("path"), "text"), f"{root}/side", flat=True)
    side = readers.json_rows(spark, f"{root}/side", "name string, label string, hide boolean")
    # Small files come some 30 to a task, and each task reports to the driver.
    found = readers.wiki_files(spark, f"{root}/pages").select("name").coalesce(tasks(spark))
    return found.join(side, "name", "left").select("name", F.coalesce("hide", F.lit(False)).alias("hide"), "label")

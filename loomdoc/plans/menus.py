"""Nested menus: a version for each kind of part, its modules are words of its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators import menus
from loomdoc.plans.cases import filled, words
from loomdoc.plans.registry import query
from loomdoc.tables import load

MODULE_INDEX = """# Modules
* [early](/docs/modules/«kind»/cold)
## Colours
* [Red](/docs/modules/«kind»/red) - first
* [Gone](/docs/modules/«kind»/gone)
### Cool ones
* [Blue](/docs/modules/«kind»/blue), [x](/docs/modules/«kind»/new)
 * [indented](/docs/modules/«kind»/hot)
* [again](/docs/modules/«kind»/red)
### Nothing here
* [Gone](/docs/modules/«kind»/gone)
## Empty
### Also empty
## Last {#last}
* [of another version](/docs/modules/x«kind»/old)
* [Rtp](/docs/modules/«kind»/rtp.io)"""
MANUAL_INDEX = """# Manual
  * [before](/docs/manual/«kind»/intro)
* **Start's «kind»**
  * [Install](/docs/manual/«kind»/install)
  * [outside](https://x.example/)
* **Nothing**
* **Reference**
  * [Modules documentation](/docs/manual/«kind»/modules)
  * [Files](/docs/manual/«kind»/files#x)
  * [Options](/docs/manual/«kind»/options)"""

NESTED_SQL = """WITH p AS (SELECT DISTINCT p_type AS kind, split_part(p_name, ' ', 1) AS stem FROM part),
listed AS (SELECT kind, stem FROM p WHERE stem <> 'old' OR kind < 'M'),
kinds AS (SELECT DISTINCT kind FROM p),
item AS (SELECT kind, stem, '{"label":"' || upper(stem) || '","slug":"docs/modules/' || kind || '/' || stem || '"}' AS one,
    '{' || chr(10) || '@  label: ''' || upper(stem) || ''',' || chr(10) || '@  slug: ''docs/modules/' || kind || '/' || stem || ''',' || chr(10) || '@},' || chr(10) AS script FROM listed),
rest AS (SELECT kind, '{"label":"Other","collapsed":true,"items":[' || string_agg(one, ',' ORDER BY stem) || ']}' AS other,
    string_agg('@' || script, '' ORDER BY stem) AS script FROM item WHERE stem NOT IN ('red', 'blue') GROUP BY kind),
modules AS (SELECT k.kind, concat_ws(',',
    '{"label":"Colours","collapsed":true,"items":[' || nullif(concat_ws(',', r.one, '{"label":"Cool ones","collapsed":true,"items":[' || b.one || ']}'), '') || ']}',
    '{"label":"Last","collapsed":true,"items":[{"label":"Rtp.IO","slug":"docs/modules/' || k.kind || '/rtpio"}]}', o.other) AS items
  FROM kinds k LEFT JOIN item r ON r.kind = k.kind AND r.stem = 'red' LEFT JOIN item b ON b.kind = k.kind AND b.stem = 'blue' LEFT JOIN rest o ON o.kind = k.kind)
SELECT kind AS menu, '[{"label":"Overview","slug":"docs/manual/' || kind || '"},{"label":"Start''s ' || kind || '","collapsed":true,"items":[{"label":"Install","slug":"docs/manual/' || kind
  || '/install"}]},{"label":"Reference","collapsed":true,"items":[{"label":"Modules documentation","collapsed":true,"items":[{"label":"Overview","slug":"docs/manual/' || kind || '/modules"},'
  || items || ']},{"label":"Options","slug":"docs/manual/' || kind || '/options"}]}]' AS json FROM modules
UNION ALL SELECT 'flat ' || kind, '[' || string_agg(replace(one, kind || '/', 'flat ' || kind || '/'), ',' ORDER BY stem) || ']' FROM item GROUP BY kind
UNION ALL SELECT 'bare ' || kind, '[{"label":"Overview","slug":"docs/manual/bare ' || kind || '"}]' FROM kinds"""


@query("nested_menus", NESTED_SQL)
def nested_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuals' menus of four levels as JSON: sections, the modules' group in one of them, its categories and subcategories.
    Empty groups, at any level, links to pages that are not there and second links are left out; modules that the index does
    not name are in the last group; a version without an index of modules has a flat list, one without sections its overview."""
    rows = words(spark, sf_dir).select("kind", F.col("first").alias("stem")).distinct()
    kinds = rows.select("kind").distinct()
    listed = rows.select(F.col("kind").alias("menu"), "stem", F.concat(F.upper("stem"), F.lit(" Module")).alias("title"), ((F.col("stem") == "old") & (F.col("kind") >= "M")).alias("hidden"))
    listed = listed.unionByName(kinds.select(F.col("kind").alias("menu"), F.lit("rtp.io").alias("stem"), F.lit("Rtp.IO module").alias("title"), F.lit(None).cast("boolean").alias("hidden")))
    flat = listed.filter("stem <> 'rtp.io'").withColumn("menu", F.concat(F.lit("flat "), "menu"))
    entries = menus.module_entries(listed.unionByName(flat))
    index = kinds.select(F.col("kind").alias("menu"), filled(MODULE_INDEX).alias("text"))
    modules = menus.module_menu(index, entries)
    texts = kinds.select(F.col("kind").alias("menu"), filled(MANUAL_INDEX).alias("text"))
    bare = kinds.select(F.concat(F.lit("bare "), "kind").alias("menu"), F.lit("no sections\n").alias("text"))
    manuals = menus.manual_menu(texts.unionByName(bare), modules)
    every = manuals.unionByName(modules.filter(F.startswith("menu", F.lit("flat "))))
    return menus.menu_texts(every).select("menu", "json")


SECTIONS_SQL = """WITH p AS (SELECT DISTINCT p_brand AS menu, p_size AS n FROM part),
there AS (SELECT DISTINCT menu, n FROM p WHERE n % 3 <> 0),
leaf AS (SELECT menu, n, (n % 5) AS a, (n % 2) AS b FROM there WHERE n < 30),
item AS (SELECT *, '{"label":"P' || n || '","slug":"' || menu || '/p' || n || '"}' AS one,
  repeat('  ', CASE WHEN b = 0 THEN 3 ELSE 5 END) AS pad FROM leaf),
script AS (SELECT *, pad || '{' || chr(10) || pad || '  label: ''P' || n || ''',' || chr(10) || pad || '  slug: ''' || menu || '/p' || n || ''',' || chr(10) || pad || '},' || chr(10) AS told FROM item),
groups AS (SELECT menu, a, string_agg(one, ',' ORDER BY n) FILTER (b = 0) AS own, string_agg(one, ',' ORDER BY n) FILTER (b = 1) AS inner_items,
  string_agg(told, '' ORDER BY n) FILTER (b = 0) AS own_told, string_agg(told, '' ORDER BY n) FILTER (b = 1) AS inner_told FROM script GROUP BY menu, a),
shown AS (SELECT menu, a, '{"label":"A' || a || '","collapsed":true,"items":[' || concat_ws(',', own, '{"label":"B' || a || '","collapsed":true,"items":[' || inner_items || ']}') || ']}' AS j,
  '  {' || chr(10) || '    label: ''A' || a || ''',' || chr(10) || '    collapsed: true,' || chr(10) || '    items: [' || chr(10) || coalesce(own_told, '')
  || coalesce('      {' || chr(10) || '        label: ''B' || a || ''',' || chr(10) || '        collapsed: true,' || chr(10) || '        items: [' || chr(10) || inner_told || '        ],' || chr(10) || '      },' || chr(10), '')
  || '    ],' || chr(10) || '  },' || chr(10) AS t FROM groups),
moved AS (SELECT menu, n, '{"label":"Migration Guide","slug":"' || menu || '/migration-' || n || '"}' AS j,
  '  {' || chr(10) || '    label: ''Migration Guide'',' || chr(10) || '    slug: ''' || menu || '/migration-' || n || ''',' || chr(10) || '  },' || chr(10) AS t FROM p WHERE n > 45),
every AS (SELECT menu, a AS k, lpad(CAST(a AS VARCHAR), 3, '0') AS s, j, t FROM shown UNION ALL SELECT menu, 1000, 'migration-' || n, j, t FROM moved)
SELECT menu, '[' || string_agg(j, ',' ORDER BY k, s) || ']' AS json, '[' || chr(10) || string_agg(t, '' ORDER BY k, s) || ']' AS script FROM every GROUP BY menu"""


@query("version_sections", SECTIONS_SQL)
def version_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template of two levels of groups for all versions: each has what it has pages for, with migration pages at the end."""
    part = load(spark, sf_dir, "part").select(F.col("p_brand").alias("menu"), F.col("p_size").alias("n")).distinct()
    number = F.col("n").cast("string")
    pages = part.filter("n % 3 <> 0").select("menu", F.concat(F.lit("p"), number).alias("page"))
    pages = pages.unionByName(part.filter("n > 45").select("menu", F.concat(F.lit("migration-"), number).alias("page")))
    n = spark.range(30).select(F.col("id").alias("n"), (F.col("id") % 5).alias("a"), (F.col("id") % 2).alias("b"))
    path = F.when(F.col("b") == 0, F.array("a", "n")).otherwise(F.array(F.col("a"), F.lit(1000).cast("long"), F.col("n")))
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    leaves = n.select(path.alias("path"), text("P", "n").alias("label"), text("p", "n").alias("page"))
    five, none = spark.range(5).select(F.col("id").alias("a")), F.lit(None).cast("string").alias("page")
    outer = five.select(F.array("a").alias("path"), text("A", "a").alias("label"), none)
    inner = five.select(F.array(F.col("a"), F.lit(1000).cast("long")).alias("path"), text("B", "a").alias("label"), none)
    template = leaves.unionByName(outer).unionByName(inner)
    return menus.menu_texts(menus.version_sections(template, pages, F.startswith("page", F.lit("migration-"))))

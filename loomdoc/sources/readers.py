"""Readers: stored pages, XML, Markdown trees, commit logs, indexes, feeds and static tables, as DataFrames.

Files come through Spark's readers only, so a path may be any URI. Trees are partitioned as ``<root>/<slug>/...``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions.html import decode_entities
from loomdoc.functions.values import feed_date, iso_date, json_or_empty
from loomdoc.operators.page_heads import with_heads
from loomdoc.sources import page_tree

STEM = r"([^/]+?)(?:\.[^./]+)?$"


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, name, content: binary) of all files below ``root``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, stem, body) of UTF-8 files below ``root``; ``stem`` is the name without its ending."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), F.regexp_extract(path, STEM, 1).alias("stem"), F.col("value").alias("body"))


def wiki_files(spark: SparkSession, root: str) -> DataFrame:
    """Stored wiki pages: dotted names that are no source or page files and not hidden."""
    return files(spark, root).filter(F.col("name").rlike(r"^[^.]+\.[^.]+$") & ~F.col("name").rlike(r"\.(py|mdx?)$"))


def front_matter(pages: DataFrame) -> DataFrame:
    """``title``, ``hidden`` and ``body`` without the head, for pages (.., body); their heads are read as YAML."""
    rows = with_heads(pages, "body").withColumn("title", F.nullif(F.trim("head.title"), F.lit("")))
    return rows.withColumn("hidden", F.coalesce("head.sidebar.hidden", F.lit(False))).drop("head", "whole", "faults")


def first_available(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``local``, and those of ``remote`` whose key ``local`` lacks."""
    return local.unionByName(remote.join(local.select(*keys).distinct(), keys, "left_anti").select(*local.columns))


def redirects(pages: DataFrame) -> DataFrame:
    """(key, target) of pages (name, body) that redirect: keys in lower case without underscores."""
    target = F.regexp_extract("body", r"\(:redirect\s+([^\s:)]+)", 1)
    key = F.replace(F.lower("name"), F.lit("_"), F.lit(""))
    return pages.select(key.alias("key"), target.alias("target")).filter("target <> ''")


def commit_log(lines: DataFrame) -> DataFrame:
    """(module, sha, author_raw, date, file, added, deleted) of a log (module, pos, line): headers ``sha<TAB>author<TAB>date``
    and numstat lines ``added<TAB>deleted<TAB>file``; ``-`` (binary) is null. A header holds until the next. Counts of seven
    digits and more could be an abbreviated sha: two numbers are counts, unless a day follows them."""
    from loomdoc.operators.lines import so_far

    part = F.split("line", "\t")
    is_counts = F.col("line").rlike("^(-|[0-9]{1,19})\t(-|[0-9]{1,19})\t") & ~F.col("line").rlike("^[^\t]*\t[^\t]*\t[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:")
    is_header = F.col("line").rlike("^[0-9a-f]{7,40}\t") & ~is_counts
    header = F.struct(part[0].alias("sha"), F.get(part, 1).alias("author_raw"), iso_date(F.get(part, 2)).alias("date"))
    rows = lines.withColumn("__header", F.last(F.when(is_header, header), ignorenulls=True).over(so_far("module")))
    rows = rows.filter(is_counts)
    number = lambda c: c.try_cast("long")
    return rows.select("module", "__header.*", part[2].alias("file"), number(part[0]).alias("added"), number(part[1]).alias("deleted"))


def anchor_index(texts_: DataFrame) -> DataFrame:
    """(section, slug, page, ref, id) of JSON maps (section, json) {``slug/page``: {ref: id}}; invalid JSON has no rows."""
    pages = json_or_empty(F.col("json"), "map<string, map<string, string>>")
    rows = texts_.select("section", F.explode(pages).alias("key", "refs")).select("section", "key", F.explode("refs").alias("ref", "id"))
    return rows.select(
        "section", F.substring_index("key", "/", 1).alias("slug"), F.expr("substring(key, locate('/', key) + 1)").alias("page"), "ref", "id"
    )


def feed_items(feeds: DataFrame, most: int = 5) -> DataFrame:
    """(source, pos, title, link, pub_date, description, author) of RSS texts (source, xml): the first items of each."""
    items = F.slice(F.regexp_extract_all("xml", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1)), 1, most)
    rows = feeds.select("source", F.posexplode(items).alias("pos", "item"))

    def part(tag: str) -> Column:
        raw = F.regexp_extract("item", rf"(?s)<{tag}[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)
        return F.nullif(F.trim(decode_entities(F.regexp_replace(raw, "<[^>]*>", ""))), F.lit(""))

    about = F.concat(F.left(F.coalesce(part("description"), F.lit("")), F.lit(200)), F.lit("…"))
    return rows.select(
        "source", "pos", part("title").alias("title"), part("link").alias("link"), feed_date(part("pubDate")).alias("pub_date"),
        about.alias("description"), F.coalesce(part("dc:creator"), part("author")).alias("author"),
    )


def schema_tree(spark: SparkSession, root: str, product: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Modules (slug, module_file, xml), tables (slug, table_file, xml) and entities (scope, name, value) of the database
    descriptions of all versions, ``<root>/<slug>/``: files at a version's top named after the product are modules,
    ``entities.xml`` has the declarations, all other XML files are tables by their path.

    Tables can be very many, and Spark's readers have the driver list all files. Where Arrow knows the file system tasks list them,
    and read the tables; the driver has the paths of modules and declarations, which are few."""
    base = re.sub("^file:/*", "/", root.rstrip("/"))
    below = lambda i: F.regexp_extract(F.col("_metadata.file_path"), rf"{re.escape(base)}/([^/]+)/(.+)$", i)

    placed = lambda rows: rows.select(below(1).alias("slug"), below(2).alias("file"), F.col("value").alias("xml"))
    names = page_tree.file_names(spark, root, ".xml") if page_tree.reachable(root) else None

    def named_like(pattern: str) -> DataFrame:
        """Only files whose names fit are opened: of very many tables, modules and declarations are few."""
        if names is None:
            return placed(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True))
        fits = F.col("path").rlike("(^|/)" + re.escape(pattern).replace(r"\*", "[^/]*") + "$")
        # Characters that a glob has a meaning for are meant as they are.
        paths = [re.sub(r"[\[\]{}*?\\]", r"\\\g<0>", f"{root.rstrip('/')}/{r['version']}/{r['path']}") for r in names.filter(fits).collect()]
        return placed(spark.read.text(paths, wholetext=True)) if paths else spark.createDataFrame([], "slug string, file string, xml string")

    def all_tables() -> DataFrame:
        if names is None:
            return named_like("*.xml")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        return page_tree.file_texts(names, root, tasks).select(F.col("version").alias("slug"), F.col("path").alias("file"), F.col("text").alias("xml"))

    is_module, is_entities = F.col("file").rlike(rf"^{re.escape(product)}-[\w.-]+\.xml$"), F.col("file") == "entities.xml"
    named = lambda rows, name: rows.select("slug", F.col("file").alias(name), "xml")
    declared = named_like("entities.xml").filter(is_entities).select(F.col("slug").alias("scope"), F.col("xml").alias("text"))
    modules, tables = named_like(f"{product}-*.xml").filter(is_module), all_tables().filter(~is_module & ~is_entities)
    return named(modules, "module_file"), named(tables, "table_file"), entity_rows(declared)


def page_collection(pages: DataFrame, root: str) -> DataFrame:
    """(route, title, hidden, body) of a tree's pages (path, body): routes are paths below ``root`` without ending, an index
    page's is that of its folder."""
    below = F.regexp_extract("path", rf"{re.escape(root.rstrip('/'))}/(.*?)\.mdx?$", 1)
    route = F.lower(F.regexp_replace(below, r"(^|/)index$", ""))
    rows = front_matter(pages.filter(F.col("path").rlike(r"\.mdx?$")))
    return rows.select(route.alias("route"), "title", "hidden", "body")


def by_stem(pages: DataFrame) -> DataFrame:
    """(key, slug): a route for each name that links use, of a tree's pages (route); of several the last one by route
    counts. Pages of modules and manuals have links of their own kind and are left out."""
    parts = F.split("route", "/")
    rows = pages.filter(~F.array_contains(parts, "modules") & ~F.array_contains(parts, "manual"))
    key = F.translate(F.element_at(parts, -1), "-_", "")
    return rows.groupBy(key.alias("key")).agg(F.concat(F.lit("/"), F.max("route")).alias("slug"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; fields an object lacks are null."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def ordered_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A static table with ``ord``, the place of each row."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {schema}")


def entity_rows(files_: DataFrame) -> DataFrame:
    """(scope, name, value) of declarations in texts (scope, text); a single-quoted value wins over a double-quoted one."""
    double = F.regexp_extract_all("text", F.lit(r'<!ENTITY\s+[\w.-]+\s+"[^"]*"\s*>'), F.lit(0))
    single = F.regexp_extract_all("text", F.lit(r"<!ENTITY\s+[\w.-]+\s+'[^']*'\s*>"), F.lit(0))
    rows = files_.select("scope", F.explode(F.concat(double, single)).alias("d"))
    name, value = F.regexp_extract("d", r"ENTITY\s+([\w.-]+)", 1), F.regexp_extract("d", r"""(?s)["'](.*)["']""", 1)
    rows = rows.select("scope", name.alias("name"), value.alias("value"), F.when(F.col("d").contains("'"), 0).otherwise(1).alias("p"))
    return rows.groupBy("scope", "name").agg(F.min_by("value", "p").alias("value"))


def resolved_entities(entities: DataFrame, rounds: int = 10) -> DataFrame:
    """(scope, name, value, open) with references between entities of a scope replaced, ``rounds`` deep; a reference to itself
    and unknown ones stay. ``open`` tells values that still refer to another known entity then, as those of a cycle do. A
    scope's table is small: it is one map, gathered once and not joined back, and each round is an expression over it."""
    table = entities.filter("scope IS NOT NULL").groupBy("scope").agg(F.collect_list(F.struct("name", "value")).alias("all"))
    rows = table.select("scope", F.map_from_entries("all").alias("m"), F.inline("all"))
    names = F.array_distinct(F.regexp_extract_all("value", F.lit(r"&([\w.-]+);"), F.lit(1)))
    known = F.filter(names, lambda n: (n != F.col("name")) & F.map_contains_key("m", n))
    for _ in range(rounds):
        put = F.aggregate(known, F.col("value"), lambda v, n: F.replace(v, F.concat(F.lit("&"), n, F.lit(";")), F.element_at("m", n)))
        rows = rows.withColumn("value", put)
    return rows.select("scope", "name", "value", (F.size(known) > 0).alias("open"))

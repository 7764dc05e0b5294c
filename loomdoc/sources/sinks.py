"""Writers: pages per version, indexes and menus. Every run leaves the same files, so a lost job is run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.operators.index import upsert_pages


def write_tree(pages: DataFrame, path: str) -> None:
    """(slug, page, body) as Parquet partitioned by version; the whole tree is replaced."""
    pages.write.mode("overwrite").partitionBy("slug").parquet(path)


def write_versions(pages: DataFrame, path: str) -> None:
    """As ``write_tree``, but only versions that ``pages`` has are replaced."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").parquet(path)


def index_json(index: DataFrame) -> DataFrame:
    """(section, json): the anchor index (section, slug, page, ref, id) as sorted JSON maps; pages without refs have none."""
    refs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref", "id"))))
    pages = index.groupBy("section", F.concat_ws("/", "slug", "page").alias("key")).agg(refs.alias("refs"))
    name = F.to_json(F.array("key"))  # as an array, of which the brackets go
    entry = F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.to_json("refs"))
    rows = pages.select("section", "key", entry.alias("entry")).groupBy("section").agg(F.array_sort(F.collect_list(F.struct("key", "entry"))).alias("all"))
    return rows.select("section", F.concat(F.lit("{"), F.array_join(F.col("all.entry"), ","), F.lit("}")).alias("json"))


def merged_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """The index after a run: whole page maps of ``new`` replace old ones."""
    return upsert_pages(old, new, ["section", "slug", "page"])


def write_menus(menus: DataFrame, path: str) -> None:
    """(slug, items) as one JSON object per line."""
    menus.coalesce(1).write.mode("overwrite").json(path)


def page_text(head: Column, body: Column) -> Column:
    """A page file's text: the head (see ``operators.pages.front_matter``), a blank line, the body, a newline."""
    return F.concat(head, F.lit("\n"), body, F.lit("\n"))


def write_pages(pages: DataFrame, path: str) -> None:
    """(slug, page, text) as one folder of text for each page; only pages that are there are replaced."""
    rows = pages.select("slug", "page", F.col("text").alias("value")).repartition("slug", "page")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("slug", "page").text(path)


def write_flat(pages: DataFrame, path: str) -> None:
    """(page, body) at the top of a tree: pages of the same name are replaced, versions below it stay."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page").parquet(path)


def script_text(c: Column) -> Column:
    """A string as a literal of the menu script."""
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def script_items(items: Column) -> Column:
    """An array of (label, slug, collapsed) as the menu script's list, two spaces a level; null fields are left out."""

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"    {name}: "), value, F.lit(",\n")))

    def one(x: Column) -> Column:
        fields = [field("label", script_text(x["label"])), field("slug", script_text(x["slug"])), field("collapsed", x["collapsed"].cast("string"))]
        return F.concat(F.lit("  {\n"), F.concat_ws("", *fields), F.lit("  },\n"))

    return F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(items, one), ""), F.lit("]")))


def manifest(rows: DataFrame, key: str) -> DataFrame:
    """One row: all of ``rows``, which is a list of a fixed size such as the logos of a page, as a JSON array by ``key``."""
    fields = [c for c in rows.columns if c != key]
    entry = F.struct(F.col(key), F.struct(key, *fields).alias("row"))
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["row"])).alias("json"))

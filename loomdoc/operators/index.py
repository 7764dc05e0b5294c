"""The anchor index and link resolution: broadcast-size lookups written as joins, so that size decides the strategy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.operators.lines import numbered


def upsert_pages(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole page maps of ``new`` replace those of ``old``; pages that ``new`` lacks stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def first_by_priority(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """One value per key: that of the first source that has the key."""
    marked = [s.select(key, value, F.lit(i).alias("__p")) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, marked)
    return every.groupBy(key).agg(F.min_by(value, "__p").alias(value))


def resolve_refs(links: DataFrame, index: DataFrame) -> DataFrame:
    """Links (section, slug, page, ref) with ``ref`` as the index says: the new id; a positional ref (``tocN``) that a known
    page lacks is dropped (null); refs of unknown pages and other unknown refs stay. ``state`` says which it was."""
    ids = index.select("section", "slug", "page", "ref", F.col("id").alias("__id"))
    known = index.select("section", "slug", "page").distinct().withColumn("__known", F.lit(True))
    joined = links.join(ids, ["section", "slug", "page", "ref"], "left").join(known, ["section", "slug", "page"], "left")
    dropped = F.col("__known").isNotNull() & F.col("ref").rlike("^toc[0-9]+$")
    state = (
        F.when(F.col("__id") == F.col("ref"), "same").when(F.col("__id").isNotNull(), "resolved").when(dropped, "dropped").otherwise("kept")
    )
    ref = F.when(F.col("__id").isNotNull(), F.col("__id")).when(dropped, F.lit(None).cast("string")).otherwise(F.col("ref"))
    return joined.withColumn("state", state).withColumn("ref", ref).drop("__id", "__known")


def resolve_positions(links: DataFrame, headings: DataFrame) -> DataFrame:
    """Links (route, n) with the id of the route's n-th heading: ``dropped`` beyond its end, ``kept`` without such a page."""
    counts = headings.groupBy("route").agg(F.count(F.lit(1)).alias("__n"))
    joined = links.join(headings.select("route", "n", "id"), ["route", "n"], "left").join(counts, "route", "left")
    state = F.when(F.col("id").isNotNull(), "resolved").when(F.col("__n").isNotNull(), "dropped").otherwise("kept")
    return joined.withColumn("state", state).drop("__n")


def route_of(links: DataFrame, steps: list[tuple[str, DataFrame]], fallback: Column) -> DataFrame:
    """``route`` and ``via`` of each link (key): the first of the named lookups (key, route) that has it, in order."""
    out = links
    for i, (_, table) in enumerate(steps):
        out = out.join(table.select("key", F.col("route").alias(f"__{i}")), "key", "left")
    found = [F.col(f"__{i}") for i in range(len(steps))]
    via = reduce(lambda done, i: F.when(found[i].isNotNull(), steps[i][0]).otherwise(done), reversed(range(len(steps))), F.lit("external"))
    return out.withColumn("route", F.coalesce(*found, fallback)).withColumn("via", via).drop(*(f"__{i}" for i in range(len(steps))))


def unambiguous(labels: DataFrame, group: list[str], value: str) -> DataFrame:
    """``value`` of groups that have one only; null where they differ."""
    return labels.groupBy(*group).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def first_seen(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values of a key, at their first place."""
    return rows.groupBy(key, value).agg(F.min("pos").alias("pos"))


def grouped_entries(links: DataFrame, existing: DataFrame, rest: str = "Other") -> DataFrame:
    """Menu entries (grp, pos, page): pages of the index page's links that exist, at their first use; existing pages that no
    link names go to the group ``rest``, in name order."""
    used = links.join(existing, "page", "left_semi")
    first = Window.partitionBy("page").orderBy("pos")
    used = used.withColumn("__k", F.row_number().over(first)).filter("__k = 1").select("grp", F.col("pos").cast("long").alias("pos"), "page")
    left = existing.join(links.select("page").distinct(), "page", "left_anti")
    left = left.select(F.lit(rest).alias("grp"), "page")
    left = numbered(left, "grp", "page", F.left("page", F.lit(3)), "pos")
    return used.unionByName(left.select("grp", F.col("pos").cast("long").alias("pos"), "page"))


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """Pages (key, body) against what is deployed: nosource, unchanged, toc-only (only positional refs differ), changed."""
    without_toc = lambda c: F.regexp_replace(c, "#toc[0-9]+", "#")
    joined = before.select("key", F.col("body").alias("__old")).join(now.select("key", F.col("body").alias("__new")), "key", "left")
    kind = (
        F.when(F.col("__new").isNull(), "nosource")
        .when(F.col("__new") == F.col("__old"), "unchanged")
        .when(without_toc(F.col("__new")) == without_toc(F.col("__old")), "toc-only")
        .otherwise("changed")
    )
    return joined.select("key", kind.alias("kind"))

"""The version model: which pages exist in which versions, nearest versions, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDIRECT = '---\ntitle: "{title}"\nhead:\n  - tag: meta\n    attrs:\n      http-equiv: refresh\n      content: "0; url={target}"\nsidebar:\n  hidden: true\n---\n'


def page_union(pages: DataFrame, key: str = "page") -> DataFrame:
    """Pages that any version has."""
    return pages.select(key).distinct()


def missing_pairs(pages: DataFrame, versions: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """(version ord, page) pairs that do not exist, over all pages and versions; excluded pages are left out.

    ``versions`` is the version dimension, some tens of rows, so pages are multiplied by it and never by each other.
    """
    every = page_union(pages)
    if exclude:
        every = every.filter(~F.col("page").isin(exclude))
    pairs = every.join(F.broadcast(versions.select("ord"))).select("ord", "page")
    return pairs.join(pages.select("ord", "page").distinct(), ["ord", "page"], "left_anti")


def nearest_version(pages: DataFrame, versions: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """For each missing (ord, page) the existing version at the least distance; of two, the newer (smaller ord).

    An as-of search both ways: a page's versions stand in their order, and the last one that exists before a gap and the first
    one behind it are running values of one window. No gap is joined with the versions of its page.
    """
    every = page_union(pages)
    if exclude:
        every = every.filter(~F.col("page").isin(exclude))
    there = pages.select("ord", "page").distinct().withColumn("__at", F.col("ord"))
    rows = every.join(F.broadcast(versions.select("ord").distinct())).join(there, ["ord", "page"], "left")
    order = Window.partitionBy("page").orderBy("ord")
    before = F.last("__at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first("__at", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("__before", before).withColumn("__behind", behind).filter("__at IS NULL")
    nearest = F.when(F.col("__behind") - F.col("ord") < F.col("ord") - F.col("__before"), F.col("__behind")).otherwise(F.coalesce("__before", "__behind"))
    return rows.select("ord", "page", nearest.alias("nearest")).filter("nearest IS NOT NULL")


def page_identity(route: Column) -> Column:
    """struct(kind, slug, page) of a route of the site: a module's page, a manual's page (empty for its index), or a flat page,
    which has no version. What several versions have in common is kind and page."""
    parts = F.split(route, "/", -1)
    is_module = F.startswith(route, F.lit("docs/modules/")) & (F.size(parts) == 4)
    is_manual = F.startswith(route, F.lit("docs/manual/")) & (F.size(parts) >= 3)
    slug = F.get(parts, F.lit(2))
    of = lambda kind, slug, page: F.struct(F.lit(kind).alias("kind"), slug.alias("slug"), page.alias("page"))
    below = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "/")
    none = F.lit(None).cast("string")
    return F.when(is_module, of("module", slug, F.get(parts, F.lit(3)))).when(is_manual, of("manual", slug, below)).otherwise(of("flat", none, route))


def page_versions(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """(kind, page, slugs): the versions that have each module's and manual's page of ``pages`` (route, hidden) visible, in the
    order of ``versions`` (ord, slug); versions that are not listed are left out. All pages at once, in one aggregation."""
    seen = pages.filter(~F.coalesce("hidden", F.lit(False))).select(page_identity(F.col("route")).alias("p")).select("p.*")
    rows = seen.join(versions.select("ord", "slug"), "slug")
    ordered = F.array_sort(F.collect_set(F.struct("ord", "slug")))
    return rows.groupBy("kind", "page").agg(F.transform(ordered, lambda v: v["slug"]).alias("slugs"))


def redirect_stub(title: Column, target: Column) -> Column:
    """The page that sends a reader on: refresh after 0 seconds, hidden in menus."""
    head, rest = REDIRECT.split("{title}")
    middle, end = rest.split("{target}")
    return F.concat(F.lit(head), title, F.lit(middle), target, F.lit(end))


def available_versions(versions: DataFrame, pages: DataFrame) -> DataFrame:
    """Versions that have a visible page."""
    return versions.join(pages.filter(~F.coalesce("hidden", F.lit(False))), "ord", "left_semi")


def existing_entries(template: DataFrame, pages: DataFrame, group: str) -> DataFrame:
    """Menu entries (group, ord, page) whose page exists, as one list in template order."""
    there = template.join(pages.select("page").distinct(), "page", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "page")))
    return there.groupBy(group).agg(F.transform(ordered, lambda e: e["page"]).alias("entries"))


def version_slug(branch: Column) -> Column:
    """``master`` is ``devel``; dots become hyphens."""
    return F.when(branch == "master", "devel").otherwise(F.replace(branch, F.lit("."), F.lit("-")))


def page_url(slug: Column, page: Column) -> Column:
    """Route of a page; the index of a version has no last part."""
    return F.concat(F.lit("/"), slug, F.when(page == "index", F.lit("/")).otherwise(F.concat(F.lit("/"), page, F.lit("/"))))

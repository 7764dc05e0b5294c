"""Nested menus: trees of entries of any depth, as rows.

An entry is a row (menu, path, label, slug): ``path`` is an array of places from the top, so that entries in order of their
paths are the tree in preorder, and an entry's group is the one whose path its own begins with. A group has no slug. Trees
are put together, cleared and written without recursion: groups without a page below them go by a semi join with the
prefixes of pages' paths, and a text opens and closes levels by comparing an entry's depth with its neighbours'.

A menu is one text in the end, so its entries meet in one row there; all else is row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.operators.lines import carried_down, heading_parts, lines_of
from loomdoc.sources.sinks import script_text

REST = "Other"
#: Where the group of entries that no index names stands: behind all lines of an index.
LAST = (1 << 31) - 1


def module_entries(modules: DataFrame) -> DataFrame:
    """(menu, stem, label, slug, place) of the modules (menu, stem, title, hidden) that are not hidden: the title without the
    word module, the route without dots, and the place by name as people sort names."""
    shown = modules.filter(~F.coalesce("hidden", F.lit(False)))
    name = F.replace("stem", F.lit("."), F.lit(""))
    place = F.row_number().over(Window.partitionBy("menu").orderBy(F.collate(name, "UNICODE"), "stem")).cast("long")
    slug = F.concat(F.lit("docs/modules/"), "menu", F.lit("/"), name)
    return shown.select("menu", "stem", F.regexp_replace("title", r"(?i)\s+module$", "").alias("label"), slug.alias("slug"), place.alias("place"))


def page_link(line: Column, root: Column) -> Column:
    """struct(label, target) of a bullet's link to a page below ``root``; null for any other line."""
    label, target = (F.regexp_extract(line, r"^\s*\*\s+\[(.+?)\]\(([^)#\s]+)\)", i) for i in (1, 2))
    return F.when(F.startswith(target, root), F.struct(F.trim(label).alias("label"), target.alias("target")))


def module_menu(indexes: DataFrame, modules: DataFrame) -> DataFrame:
    """Entries of each menu's modules (see :func:`module_entries`), grouped as its index (menu, text) groups them: headings of
    level 2 and 3 are groups, a module is where its first link is, those that no link names are in the last group. Without an
    index they are a flat list. Links to modules that are not there, and links before any heading, are left out."""
    lines = lines_of(indexes, "menu", "text").withColumn("h", heading_parts(F.col("line")))
    lines = carried_down(lines, "menu", "cat", F.when(F.col("h.level") == 2, F.col("pos")))
    lines = carried_down(lines, "menu", "sub", F.when(F.col("h.level").isin(2, 3), F.struct(F.col("h.level").alias("level"), F.col("pos").alias("pos"))))
    lines = lines.filter(F.col("cat").isNotNull())
    within = F.when((F.col("sub.level") == 3), F.array("cat", "sub.pos")).otherwise(F.array("cat"))
    above = F.when(F.col("h.level") == 2, F.array("cat")).otherwise(F.array("cat", "pos"))
    groups = lines.filter(F.col("h.level").isin(2, 3)).select("menu", above.cast("array<long>").alias("path"), F.col("h.text").alias("label"), F.lit(None).cast("string").alias("slug"))
    root = F.concat(F.lit("/docs/modules/"), "menu", F.lit("/"))
    links = lines.withColumn("link", page_link(F.col("line"), root)).filter(F.col("link").isNotNull() & F.startswith("line", F.lit("*")))
    links = links.withColumn("stem", F.substring_index("link.target", "/", -1))
    first = links.groupBy("menu", "stem").agg(F.min_by(F.array_append(within, F.col("pos")), "pos").alias("path"))
    found = modules.join(first, ["menu", "stem"], "left")
    found = found.join(indexes.select("menu", F.lit(True).alias("__index")).distinct(), "menu", "left")
    rest = F.when(F.col("__index"), F.array(F.lit(LAST), "place")).otherwise(F.array("place"))
    entries = found.select("menu", F.coalesce(F.col("path").cast("array<long>"), rest.cast("array<long>")).alias("path"), "label", "slug")
    other = indexes.select("menu", F.array(F.lit(LAST)).cast("array<long>").alias("path"), F.lit(REST).alias("label"), F.lit(None).cast("string").alias("slug"))
    return without_empty(groups.unionByName(other).unionByName(entries))


def manual_menu(indexes: DataFrame, modules: DataFrame) -> DataFrame:
    """Entries of each manual: an overview, then the sections of its index (menu, text), bullets in bold, with the pages that
    indented bullets link. The page ``modules`` becomes a group: its own overview and the entries ``modules``. A manual
    without sections is the overview alone."""
    root = F.concat(F.lit("docs/manual/"), "menu")
    lines = lines_of(indexes, "menu", "text")
    section = F.nullif(F.trim(F.regexp_extract("line", r"^\*\s+\*\*(.+?)\*\*\s*$", 1)), F.lit(""))
    lines = carried_down(lines.withColumn("section", section), "menu", "at", F.when(F.col("section").isNotNull(), F.col("pos").cast("long")))
    link = page_link(F.col("line"), F.concat(F.lit("/"), root, F.lit("/")))
    lines = lines.filter(F.col("at").isNotNull()).withColumn("link", F.when(F.col("line").rlike(r"^\s"), link))
    none = F.lit(None).cast("string")
    path = F.array(F.col("at"), F.col("pos").cast("long"))
    slug = F.substring("link.target", F.lit(2), F.length("link.target"))
    pages = lines.filter(F.col("link").isNotNull()).select("menu", path.alias("path"), "link.label", slug.alias("slug"))
    is_modules = F.col("slug") == F.concat(root, F.lit("/modules"))
    groups = lines.filter(F.col("section").isNotNull()).select("menu", F.array("at").alias("path"), F.col("section").alias("label"), none.alias("slug"))
    nested = pages.filter(is_modules)
    heads = nested.select("menu", "path", "label", none.alias("slug"))
    overviews = nested.select("menu", F.array_append("path", F.lit(-1).cast("long")).alias("path"), F.lit("Overview").alias("label"), "slug")
    below = nested.select("menu", F.col("path").alias("__above")).join(modules, "menu")
    below = below.select("menu", F.concat("__above", "path").alias("path"), "label", "slug")
    first = indexes.select("menu", F.array(F.lit(-1)).cast("array<long>").alias("path"), F.lit("Overview").alias("label"), root.alias("slug"))
    out = first
    for part in (groups, pages.filter(~is_modules), heads, overviews, below):
        out = out.unionByName(part)
    return without_empty(out)


def version_sections(template: DataFrame, pages: DataFrame, migrations: Column | None = None) -> DataFrame:
    """Entries of each menu (menu, page): those of ``template`` (path, label, page; a group has no page) whose page is there,
    with their groups. A menu's pages for which ``migrations`` holds, a pattern of names that no template can list, come last."""
    none = F.lit(None).cast("string")
    there = pages.select("menu", "page").distinct()
    slug = F.concat("menu", F.lit("/"), "page")
    entries = template.filter("page IS NOT NULL").join(there, "page").select("menu", "path", "label", slug.alias("slug"))
    used = entries.select("menu", F.col("path").alias("__path")).distinct()
    groups = template.filter("page IS NULL").select("path", "label")
    # A group belongs to the menus that have an entry below it: prefixes of entries' paths are joined, never all menus.
    prefixes = used.select("menu", F.explode(F.transform(F.sequence(F.lit(1), F.size("__path")), lambda n: F.slice("__path", F.lit(1), n))).alias("path")).distinct()
    out = entries.unionByName(groups.join(prefixes, "path").select("menu", "path", "label", none.alias("slug")))
    if migrations is None:
        return out
    place = F.row_number().over(Window.partitionBy("menu").orderBy("page")).cast("long") + LAST
    last = there.filter(migrations).select("menu", F.array(place).alias("path"), F.lit("Migration Guide").alias("label"), slug.alias("slug"))
    return out.unionByName(last)


def without_empty(entries: DataFrame) -> DataFrame:
    """``entries`` without groups that have no page below them, however deep."""
    pages, groups = entries.filter("slug IS NOT NULL"), entries.filter("slug IS NULL")
    prefix = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    kept = pages.filter(F.size("path") > 1).select("menu", F.explode(prefix).alias("path")).distinct()
    return pages.unionByName(groups.join(kept, ["menu", "path"], "left_semi"))


def menu_texts(entries: DataFrame) -> DataFrame:
    """(menu, json, script): each menu as JSON and as the list of the site's script; groups are collapsed."""
    places = Window.partitionBy("menu").orderBy("path")
    depth = F.size("path")
    rows = entries.withColumn("depth", depth).withColumn("before", F.coalesce(F.lag(depth).over(places), F.lit(0))).withColumn("next", F.coalesce(F.lead(depth).over(places), F.lit(1)))
    closed = F.when(F.col("next") < F.col("depth"), F.sequence(F.col("depth") - 1, F.col("next"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    pad = lambda d, more=0: F.repeat(F.lit("  "), 2 * d - 1 + more)

    page = F.to_json(F.struct("label", "slug"))
    group = F.to_json(F.struct("label", F.lit(True).alias("collapsed")))
    opened = F.when(F.col("slug").isNotNull(), page).otherwise(F.concat(F.left(group, F.length(group) - 1), F.lit(',"items":[')))
    comma = F.when(F.col("before") >= F.col("depth"), ",").otherwise("")
    json = F.concat(comma, opened, F.repeat(F.lit("]}"), F.size(closed)))

    field = lambda name, value: F.concat(pad(F.col("depth"), 1), F.lit(f"{name}: "), value, F.lit(",\n"))
    end = lambda d: F.concat(pad(d), F.lit("},\n"))
    of_page = F.concat(field("slug", script_text(F.col("slug"))), end(F.col("depth")))
    of_group = F.concat(field("collapsed", F.lit("true")), pad(F.col("depth"), 1), F.lit("items: [\n"))
    closing = F.array_join(F.transform(closed, lambda d: F.concat(pad(d, 1), F.lit("],\n"), end(d))), "")
    script = F.concat(pad(F.col("depth")), F.lit("{\n"), field("label", script_text(F.col("label"))), F.when(F.col("slug").isNotNull(), of_page).otherwise(of_group), closing)

    rows = rows.select("menu", "path", json.alias("json"), script.alias("script"))
    ordered = F.array_sort(F.collect_list(F.struct("path", "json", "script")))
    joined = lambda name: F.array_join(F.transform(ordered, lambda x: x[name]), "")
    return rows.groupBy("menu").agg(
        F.concat(F.lit("["), joined("json"), F.lit("]")).alias("json"), F.concat(F.lit("[\n"), joined("script"), F.lit("]")).alias("script")
    )

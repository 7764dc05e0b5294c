"""Links in page texts: taken out as rows, resolved by joins, and put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.functions.names import OLD_DOCUMENT, OLD_MODULE, manual_ref, old_address
from loomdoc.functions.wiki import LinkMarks
from loomdoc.operators.index import resolve_positions, resolve_refs
from loomdoc.scratch import written

#: What stands between a link's label and the end of its address.
LINK = r"\]\([^)\s]+\)"

#: Groups of an address: a route of the site, a manual page beside this one, a module beside this one.
ROUTE = r"^(.*?/docs/(modules|manual)/([\w.-]+)/([\w.-]+)#)([^#\s]+)$"
MANUAL = r"^((?:\./)?([\w-]+)\.md#)([^#\s]+)$"
MODULE = r"^(\.\./modules/([\w-]+)(?:/README\.md)?#)([^#\s]+)$"
POSITION = r"^(/docs/([^#]+)|)#toc([0-9]+)$"


def link_rows(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, url) of all links of a page, in order."""
    found = F.transform(F.regexp_extract_all(body, F.lit(LINK), F.lit(0)), lambda x: F.substring(x, F.lit(3), F.length(x) - 3))
    return pages.select(key, F.posexplode(found).alias("pos", "url"))


def with_links(pages: DataFrame, key: str, body: str, links: DataFrame) -> DataFrame:
    """``pages`` with the addresses of ``links`` (key, pos, url) in place; a page keeps those that ``links`` lacks."""
    urls = links.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "url"))).alias("__urls"))
    joined = pages.join(urls, key, "left")
    old = F.regexp_extract_all(body, F.lit(LINK), F.lit(0))
    between = F.split(body, LINK, -1)

    def put(x: Column, i: Column) -> Column:
        url = F.try_element_at("__urls", i)
        return F.concat(F.when(url.isNotNull(), F.concat(F.lit("]("), url, F.lit(")"))).otherwise(x), F.get(between, i + 1))

    whole = F.concat(F.get(between, F.lit(0)), F.array_join(F.transform(old, put), ""))
    return joined.withColumn(body, F.when(F.col("__urls").isNull(), F.col(body)).otherwise(whole)).select(*pages.columns)


def with_routes(pages: DataFrame, keys: list[str], body: str, routes: DataFrame) -> DataFrame:
    """``pages`` (keys, body, targets) with addresses for the marks in ``body``: ``routes`` (keys[0], target, route) has those
    of each version's targets; a target without one is its own address. ``targets`` goes."""
    asked = pages.select(*keys, F.posexplode("targets").alias("__n", "__target"))
    known = routes.select(F.col(keys[0]), F.col("target").alias("__target"), F.col("route").alias("__route"))
    found = asked.join(known, [keys[0], "__target"], "left").groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("__n", F.coalesce("__route", "__target").alias("route")))).alias("__routes")
    )
    joined = pages.join(found, keys, "left")
    mark = f"{LinkMarks.OPEN}([0-9]+){LinkMarks.CLOSE}"
    between, numbers = F.split(body, mark, -1), F.regexp_extract_all(body, F.lit(mark), F.lit(1))
    put = F.zip_with(between, numbers, lambda text, n: F.concat(text, F.coalesce(F.try_element_at("__routes", n.cast("int")), F.lit(""))))
    return joined.withColumn(body, F.array_join(put, "")).select(*(c for c in pages.columns if c != "targets"))


def addressed(links: DataFrame, slug: str) -> DataFrame:
    """``links`` (.., url) to other pages' places, with (section, version, page, ref) of each: routes name all of it, links
    to a page or module beside this one are of this version (the column ``slug``), or of that in the page's name."""
    part = lambda pattern, i: F.regexp_extract("url", pattern, i)
    is_route, is_manual, is_module = F.col("url").rlike(ROUTE), F.col("url").rlike(MANUAL), F.col("url").rlike(MODULE)
    name = part(MANUAL, 2)
    pick = lambda a, b, c: F.when(is_route, a).when(is_manual, b).otherwise(c)
    return links.filter(is_route | is_manual | is_module).select(
        "*",
        pick(part(ROUTE, 2), F.lit("manual"), F.lit("modules")).alias("section"),
        pick(part(ROUTE, 3), F.coalesce(manual_ref(name)["slug"], F.col(slug)), F.col(slug)).alias("version"),
        pick(part(ROUTE, 4), F.coalesce(manual_ref(name)["page"], F.lower(name)), part(MODULE, 2)).alias("page"),
        pick(part(ROUTE, 5), part(MANUAL, 3), part(MODULE, 3)).alias("ref"),
        pick(part(ROUTE, 1), part(MANUAL, 1), part(MODULE, 1)).alias("__open"),
    )


def rewritten_anchors(pages: DataFrame, key: str, body: str, slug: str, index: DataFrame) -> DataFrame:
    """``pages`` (key, body, slug) whose links to places of other pages have the ids that ``index`` (section, slug, page, ref,
    id) gives; a position (``#tocN``) beyond a known page's end goes, whatever else ``index`` lacks stays."""
    slugs = pages.select(F.col(key).alias("__key"), F.col(slug).alias("__slug"))
    rows = link_rows(pages, key, body).withColumnRenamed(key, "__key").join(slugs, "__key")
    found = addressed(rows, "__slug").select("__key", "pos", "section", F.col("version").alias("slug"), "page", "ref", "__open")
    found = resolve_refs(found, index).filter(F.col("state").isin("resolved", "dropped"))
    bare = F.regexp_replace("__open", "#$", "")
    url = F.when(F.col("ref").isNull(), bare).otherwise(F.concat("__open", "ref"))
    return with_links(pages, key, body, found.select(F.col("__key").alias(key), "pos", url.alias("url")))


def rewritten_positions(pages: DataFrame, route: str, body: str, headings: DataFrame) -> DataFrame:
    """``pages`` (route, body) whose links ``#tocN`` and ``/docs/<route>#tocN`` have the N-th heading's id of ``headings``
    (route, n, id); a position beyond a page's end goes. Outside links and those to pages without headings stay."""
    rows = link_rows(pages, route, body).filter(F.col("url").rlike(POSITION)).withColumnRenamed(route, "__from")
    part = lambda i: F.regexp_extract("url", POSITION, i)
    rows = rows.select("__from", "pos", part(1).alias("__base"), F.coalesce(F.nullif(part(2), F.lit("")), "__from").alias("route"), part(3).cast("long").alias("n"))
    found = resolve_positions(rows, headings).filter(F.col("state") != "kept")
    url = F.when(F.col("id").isNull(), F.col("__base")).otherwise(F.concat("__base", F.lit("#"), "id"))
    return with_links(pages, route, body, found.select(F.col("__from").alias(route), "pos", url.alias("url")))


def rewritten_ids(pages: DataFrame, key: str, body: str, ids: DataFrame) -> DataFrame:
    """``pages`` whose links to routes of the site have new ids for old ones, by ``ids`` (section, slug, page, ref, id)."""
    rows = link_rows(pages, key, body).withColumnRenamed(key, "__key").withColumn("__slug", F.lit(None).cast("string"))
    found = addressed(rows, "__slug").filter(F.col("url").rlike(ROUTE)).withColumn("slug", F.col("version"))
    found = found.join(ids.select("section", "slug", "page", "ref", "id"), ["section", "slug", "page", "ref"]).filter("id <> ref")
    return with_links(pages, key, body, found.select(F.col("__key").alias(key), "pos", F.concat("__open", "id").alias("url")))


def rewritten_legacy(pages: DataFrame, key: str, body: str, manual_pages: DataFrame, flat_pages: DataFrame, hosts: str, origin: str) -> DataFrame:
    """``pages`` whose links to the old site, whose hosts the pattern ``hosts`` matches, lead to the new one.

    A manual's page of a version, if ``manual_pages`` (page) has it, and a document that ``flat_pages`` (slug) has are routes
    behind ``origin``; a module's page is the module beside this one, so it follows the page's version. All others stay.
    ``pages`` are written once: their links and their bodies are read from there, so a conversion before this runs once.
    """
    pages = written(pages, "pages")
    links = link_rows(pages, key, body).filter(F.col("url").rlike(rf"(?i)^https?://(?:{hosts})/"))
    rows = links.select("url").distinct()  # an address is resolved once, however many pages have it
    document, module = old_address(hosts, OLD_DOCUMENT), old_address(hosts, OLD_MODULE)
    part = lambda pattern, i: F.regexp_extract("url", pattern, i)
    path = part(document, 1)
    ref = manual_ref(F.substring_index(path, "/", -1))
    rows = rows.withColumn("__page", ref["page"]).withColumn("__slug", ref["slug"]).withColumn("__flat", F.nullif(F.lower(F.rtrim(path, F.lit("/"))), F.lit("")))
    known = manual_pages.select(F.col("page").alias("__page"), F.lit(True).alias("__of_manual")).distinct()
    flat = flat_pages.select(F.col("slug").alias("__flat"), F.lit(True).alias("__of_site")).distinct()
    rows = rows.join(known, "__page", "left").join(flat, "__flat", "left")
    new = (
        F.when(F.col("__of_manual"), F.concat(F.lit(f"{origin}/docs/manual/"), "__slug", F.lit("/"), "__page", part(document, 2)))
        .when(F.col("__of_site"), F.concat(F.lit(f"{origin}/docs/"), "__flat", part(document, 2)))
        .when(part(module, 2) != "", F.concat(F.lit("../"), part(module, 2), part(module, 3)))
    )
    routes = rows.select("url", new.alias("__new")).filter("__new IS NOT NULL")
    return with_links(pages, key, body, links.join(routes, "url").select(key, "pos", F.col("__new").alias("url")))

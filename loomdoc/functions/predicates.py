"""Which pages, files and headings belong where."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def under(path: Column, folder: str) -> Column:
    """Files below a folder."""
    return path.startswith(folder.rstrip("/") + "/")


def page_class(route: Column) -> Column:
    """``module``, ``manual``, ``flat`` or ``other``, by a route's parts: docs/modules/<version>/<module>,
    docs/manual/<version>[/..], docs/<page>."""
    parts = F.split(route, "/", -1)
    n, first, second = F.size(parts), F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    kind = F.when((second == "modules") & (n == 4), "module").when((second == "manual") & (n >= 3), "manual").when(n == 2, "flat").otherwise("other")
    return F.when(first == "docs", kind).otherwise("other")


def in_menu(folder: Column, page: Column) -> Column:
    """Pages that menus list: no single news, no list of recent changes."""
    return ~((folder == "about") & page.rlike(r"^news\d+$")) & ~(folder.isin("community", "development") & (page == "recentchanges"))


def is_active(path: Column, entries: list[Column]) -> Column:
    """Whether a menu entry is that of the page at ``path``: equal to one of its routes or below it; the root is itself only."""
    bare = lambda c: F.regexp_replace(c, "/$", "")

    def one(entry: Column) -> Column:
        here, there = bare(path), bare(entry)
        return F.when(there == "", here == "").otherwise((here == there) | F.startswith(here, F.concat(there, F.lit("/"))))

    return reduce(lambda a, b: a | b, map(one, entries))


def in_contents(level: Column) -> Column:
    """Headings that a page's table of contents has."""
    return level.between(2, 4)


def head_faults(head: Column) -> Column:
    """What is wrong with a page's head (a map of strings), as a list of names: a title is required; the optional texts are
    texts where they are there; an address is one with a scheme or a route."""
    known = lambda k: F.try_element_at(head, F.lit(k))
    link = known("subtitleHref")
    faults = F.array(
        F.when(F.length(F.trim(F.coalesce(known("title"), F.lit("")))) == 0, "title"),
        *[F.when(F.map_contains_key(head, F.lit(k)) & known(k).isNull(), k) for k in ("subtitle", "author", "description")],
        F.when(link.isNotNull() & ~link.rlike(r"^(https?://|/|#|mailto:)\S*$"), "subtitleHref"),
    )
    return F.filter(faults, lambda f: f.isNotNull())

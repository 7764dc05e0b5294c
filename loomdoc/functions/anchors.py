"""Anchor ids: slugs of heading texts and de-duplication within a page, as Spark expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions.docbook import DEVELOPER_SECTIONS, PREFIXES


def underscore_slug(text: Column) -> Column:
    """Runs of other than ASCII letters and digits become ``_``; trimmed; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def hyphen_slug(text: Column) -> Column:
    """Runs of other than ASCII letters and digits become ``-``; one trimmed on each side; lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


#: Fixed value: what forges take for emphasis.
EMPHASIS = r"[*_]{1,3}([^*_]+)[*_]{1,3}"


def forge_slug(text: Column) -> Column:
    """The slug that code forges give: code marks, links and paired emphasis stripped, lower case, marks but ``_`` and ``-``
    dropped, spaces to hyphens."""
    bare = F.regexp_replace(F.regexp_replace(text, "`([^`]*)`", "$1"), r"\[([^\]]*)\]\([^)]*\)", "$1")
    bare = F.regexp_replace(bare, EMPHASIS, "$1")
    return F.replace(F.regexp_replace(F.lower(F.trim(bare)), "[^a-z0-9 _-]", ""), F.lit(" "), F.lit("-"))


def kept_marks(text: Column) -> Column:
    """Runs of other than ASCII letters, digits, ``.``, ``_`` and ``-`` become ``_``; trimmed. Case stays."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def spaced_slug(text: Column) -> Column:
    """Lower case; ASCII letters, digits, ``_`` and ``-`` stay, each space becomes ``-``, all else goes."""
    return F.replace(F.regexp_replace(F.lower(F.trim(text)), "[^0-9a-z _-]", ""), F.lit(" "), F.lit("-"))


def _per_page(assign) -> Column:
    """A pandas UDF that runs ``assign`` over each page's list of ids: ids depend on all before them, and a dict or set
    keeps that linear in the page."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def of(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ids: assign(list(ids)) if ids is not None else None)

    return of


def free_ids(ids: list) -> list:
    used, following, out = set(), {}, []
    for id_ in ids:
        chosen = id_
        while chosen in used and id_ is not None:
            following[id_] = following.get(id_, 1) + 1
            chosen = f"{id_}_{following[id_]}"
        used.add(chosen)
        out.append(chosen)
    return out


def counted_ids(ids: list) -> list:
    count, out = {}, []
    for id_ in ids:
        chosen = id_
        while chosen in count and id_ is not None:
            count[id_] += 1
            chosen = f"{id_}-{count[id_]}"
        count.setdefault(chosen, 0)
        out.append(chosen)
    return out


def free_underscore(ids: Column) -> Column:
    """First free of ``x``, ``x_2``, ``x_3`` ... in order; literal collisions count: x, x, x_2 gives x, x_2, x_2_2. Null stays null."""
    return _per_page(free_ids)(ids)


def counted_hyphen(ids: Column) -> Column:
    """``x``, ``x-1``, ``x-2`` ...: a counter for each base, which skips what the page has: x, x-1, x gives x, x-1, x-2."""
    return _per_page(counted_ids)(ids)


def fallback_hyphen(ids: Column, explicit: Column) -> Column:
    """``x``, ``x-1`` ... by a count of each base; explicit ids are taken as they are and do not take part."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def of(lists: pd.Series, own: pd.Series) -> pd.Series:
        def assign(ids, own):
            seen, out = {}, []
            for id_, e in zip(ids, own, strict=True):
                if e is None:
                    n = seen[id_] = seen.get(id_, -1) + 1
                    e = f"{id_}-{n}" if n else id_
                out.append(e)
            return out

        return pd.Series([assign(a, b) if a is not None else None for a, b in zip(lists, own, strict=True)], dtype=object)

    return of(ids, explicit)


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def item_name(prefix: Column, text: Column) -> Column:
    """The name in an item's heading: before a bracket; after the last colon for MI; no ``$`` for variables; events in lower case."""
    text = F.trim(text)
    before = F.regexp_extract(text, r"^[^(]*", 0)
    after = F.regexp_extract(F.regexp_extract(text, r"[^:]*$", 0), r"^[^(]*", 0)
    variable = F.regexp_extract(F.regexp_replace(text, r"^\$\(?", ""), r"^[^(\[]*", 0)
    name = F.when(prefix == "mi", after).when(prefix == "pv", variable).when(prefix.isin("func", "afunc", "param"), before).otherwise(text)
    return F.when(prefix == "event", F.lower(_bare(name))).otherwise(_bare(name))


def item_id(level: Column, text: Column, section: Column, guide: Column) -> Column:
    """Prefix and name for items (level 4 and more) of a typed section; ``dev_`` in function sections of a developer guide;
    else the slug."""
    table = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    key = F.lower(F.coalesce(section, F.lit("")))
    prefix = F.try_element_at(table, key)
    typed = F.concat(prefix, F.lit("_"), item_name(prefix, text))
    developer = F.lower(F.trim(guide)).isin("developer guide", "developer's guide") & key.isin(*sorted(DEVELOPER_SECTIONS))
    of_guide = F.concat(F.lit("dev_"), item_name(F.lit("func"), text))
    return F.when((level >= 4) & prefix.isNotNull(), typed).when((level >= 4) & developer, of_guide).otherwise(underscore_slug(text))

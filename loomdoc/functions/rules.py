"""Rules of titles, links and ids that hold for some pages only, as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.functions.anchors import kept_marks, spaced_slug, underscore_slug
from loomdoc.functions.docbook import ADMIN_SECTIONS, GUIDES, SECTIONS

# How manual pages name their items, ids that are forced, and the aside of each callout.
ITEM_PAGES = {
    "script-coreparameters": "parameter",
    "script-corefunctions": "function",
    "script-routes": "whole",
    "interface-corestatistics": "whole",
    "interface-coremi": "command",
    "interface-coreevents": "event",
    "script-tran": "transformation",
    "script-corevar": "variable",
}
FORCED_IDS = {
    ("script-coreparameters", "memdump | mem_dump"): "memdump",
    ("script-coreparameters", "memlog | mem_log"): "memlog",
    ("install-download", "GIT download"): "git",
    ("install-download", "Packages download - preferred method"): "packages",
    ("script-async", "Serial asynchronous operations, async()"): "async",
    ("script-async", "Parallel asynchronous operations, launch()"): "launch",
    ("script-async", "List of async functions"): "async_functions",
    ("script-async", "Limitations"): "async_limitations",
    ("script-async", "Allowed Routes"): "async_routes",
    ("interface-coreevents", "Script profiling event"): "E_PROFILING_SCRIPT",
}
ASIDES = {"NOTE": "note", "TIP": "tip", "IMPORTANT": "caution", "WARNING": "danger", "CAUTION": "danger"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def canonical_title(title: Column, level: Column, guide: Column) -> Column:
    """The usual spelling of guide titles (level 2) and section titles (deeper); others stay. Some bare titles have one
    under the administrators' guide only."""
    key = F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))
    bare = F.when(guide == "Admin Guide", _lookup(ADMIN_SECTIONS, key))
    return F.coalesce(F.when(level == 2, _lookup(GUIDES, key)).otherwise(F.coalesce(bare, _lookup(SECTIONS, key))), title)


def module_title(title: Column) -> Column:
    """Without quotes, in capitals but for the word ``module`` at the end, which is added if it lacks."""
    bare = F.trim(F.regexp_replace(title, "[\"']", ""))
    name = F.trim(F.regexp_replace(bare, r"(?i)\s*\bmodule$", ""))
    return F.concat(F.upper(name), F.lit(" module"))


def aside_of(alert: Column) -> Column:
    """The aside type of a callout's kind."""
    return _lookup(ASIDES, F.upper(alert))


def site_links(body: Column, slug: Column, origin: str) -> Column:
    """Links of a repository's pages as site routes: ``x.md`` and ``../modules/x/README.md`` get the version, the site's
    own origin is dropped. Anchors stay; outside links are untouched."""
    module = F.concat(F.lit("](/docs/modules/"), slug, F.lit("/$1$2)"))
    page = F.concat(F.lit("](/docs/manual/"), slug, F.lit("/$1$2)"))
    body = F.regexp_replace(body, F.lit(r"\]\(\.\./modules/([\w-]+)/README\.md(#[^)]*)?\)"), module)
    body = F.regexp_replace(body, F.lit(r"\]\((?:\./)?([\w-]+)\.md(#[^)]*)?\)"), page)
    return F.replace(body, F.lit(f"]({origin}/docs/"), F.lit("](/docs/"))


def without_sample_line(body: Column) -> Column:
    return F.regexp_replace(body, r"(?m)^\[[^\]]*\]\(\./samples\.md \"include\"\)\n?", "")


def with_samples(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """Pages (module, body): the sample include stays where the module has samples, else its line goes."""
    there = samples.select("module").distinct().withColumn("__there", F.lit(True))
    joined = pages.join(there, "module", "left")
    return joined.withColumn("body", F.when(F.col("__there"), F.col("body")).otherwise(without_sample_line(F.col("body")))).drop("__there")


def hidden(body: Column) -> Column:
    """A page's head with ``sidebar: hidden``; a page that has it stays."""
    marked = F.regexp_replace(body, r"(?s)\A---\n(.*?)\n---\n", "---\n$1\nsidebar:\n  hidden: true\n---\n")
    return F.when(body.rlike(r"(?m)^\s+hidden:\s*true\s*$"), body).otherwise(marked)


def manual_id(page: Column, text: Column, ahead: Column) -> Column:
    """The id of a manual page's heading before duplicates are told apart; null if nothing of the text can be one.

    A forced id goes before the page's rule; where a rule finds no item in the text, the id is the text's slug. ``ahead`` is
    the text behind the heading, where events are named. Pages without a rule have spaced slugs.
    """
    bare = F.trim(F.regexp_replace(text, "[`*]", ""))
    slug = underscore_slug(bare)
    inner = F.regexp_replace(bare, r"^[{}]+|[{}]+$", "")
    variable = F.regexp_extract(bare, r"\$\(?\{?([A-Za-z0-9_.]+)", 1)
    rules = {
        "whole": kept_marks(bare),
        "parameter": F.when(bare.rlike(r"^[A-Za-z_][\w.-]*$"), kept_marks(bare)).otherwise(slug),
        "function": kept_marks(F.substring_index(bare, "(", 1)),
        "command": kept_marks(F.replace(F.regexp_extract(bare, r"^[^\s\[]*", 0), F.lit(":"), F.lit("_"))),
        "transformation": F.when(bare.startswith("{"), kept_marks(F.substring_index(inner, ",", 1))).otherwise(slug),
        "variable": F.when(variable != "", kept_marks(variable)).otherwise(slug),
        "event": F.coalesce(F.nullif(F.regexp_extract(ahead, r"\*\*Event\*\*:\s*([A-Za-z0-9_]+)", 1), F.lit("")), slug),
    }
    kind = _lookup(ITEM_PAGES, page)
    forced = forced_id(page, bare)
    by_rule = reduce(lambda done, k: F.when(kind == k, rules[k]).otherwise(done), rules, spaced_slug(bare))
    return F.coalesce(forced, F.nullif(by_rule, F.lit("")))


def forced_id(page: Column, text: Column) -> Column:
    """The id that a heading of a manual's page has by decree; null for others."""
    return _lookup({f"{p}|{t}": i for (p, t), i in FORCED_IDS.items()}, F.concat(page, F.lit("|"), text))


def has_rule(page: Column) -> Column:
    return page.isin(*ITEM_PAGES)

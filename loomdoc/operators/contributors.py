"""Contributor analytics: per-author statistics, scores, ranks and overflow lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Authors listed in a module's table; the rest go to its overflow line.
TABLE_SIZE = 10


def drop_empty_commits(commits: DataFrame) -> DataFrame:
    """Commits that changed at least one line; merges and mode changes go."""
    return commits.filter((F.col("added") > 0) | (F.col("deleted") > 0))


def author_stats(commits: DataFrame, by: list[str]) -> DataFrame:
    """Commit count, line sums and first and last date of each group; null dates are ignored."""
    return commits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("added").alias("added"),
        F.sum("deleted").alias("deleted"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def devscore(add_rate: Column, del_rate: Column) -> Column:
    """commits + ceil(added / add_rate) + ceil(deleted / del_rate): lines count as the commits they usually take."""
    return (F.col("commits") + F.ceil(F.col("added") / add_rate) + F.ceil(F.col("deleted") / del_rate)).cast("long")


def line_rates(commits: DataFrame) -> DataFrame:
    """One row: lines added and deleted per commit over everything (add_rate, del_rate)."""
    n = F.count(F.lit(1))
    return commits.agg((F.sum("added") / n).alias("add_rate"), (F.sum("deleted") / n).alias("del_rate"))


def with_score(stats: DataFrame, rates: DataFrame) -> DataFrame:
    """Statistics with ``score``; the rates are one row by construction, so the broadcast is bounded."""
    joined = stats.join(F.broadcast(rates))
    return joined.withColumn("score", devscore(F.col("add_rate"), F.col("del_rate"))).drop("add_rate", "del_rate")


def ranked(stats: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rn`` numbers the rows of a group in the given order."""
    return stats.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def by_score() -> list[Column]:
    return [F.desc("score"), F.desc("commits"), F.desc("added"), F.asc("author")]


def by_activity() -> list[Column]:
    """Latest first; an author without dates sorts as the epoch."""
    return [F.desc(F.coalesce(F.unix_timestamp("last_date"), F.lit(0))), F.asc("author")]


def overflow_line(table: DataFrame, group: str, size: int = TABLE_SIZE) -> DataFrame:
    """A group's authors beyond the table, in rank order, joined by ``", "``; groups without any have no row."""
    rest = table.filter(F.col("rn") > size)
    return rest.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_more"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "author"))), lambda x: x["author"]), ", ").alias("more"),
    )


def commits_from_numstat(files: DataFrame) -> DataFrame:
    """Commits (module, sha, author, date, added, deleted) from one row per changed file; a null count (binary) is 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return files.groupBy("module", "sha").agg(
        F.min("author").alias("author"), F.min("date").alias("date"), F.sum(zero("added")).alias("added"), F.sum(zero("deleted")).alias("deleted")
    )


def without_skipped(commits: DataFrame, skipped: DataFrame, key: str = "sha") -> DataFrame:
    """Commits that are not on the skip list."""
    return commits.join(skipped.select(key).distinct(), key, "left_anti")


def with_overrides(commits: DataFrame, overrides: DataFrame) -> DataFrame:
    """``author`` replaced where the commit's sha has an override (sha, fixed)."""
    joined = commits.join(overrides.select("sha", "fixed"), "sha", "left")
    return joined.withColumn("author", F.coalesce("fixed", "author")).drop("fixed")


def name_only(author: Column) -> Column:
    """A raw author without the mail address in angle brackets."""
    return F.trim(F.regexp_replace(author, r"\s*<[^>]*>", ""))


def canonical_author(commits: DataFrame, aliases: DataFrame) -> DataFrame:
    """``author`` through the alias table (raw, canonical): the full string first, then the name alone; one hop."""
    full = aliases.select(F.col("raw").alias("__full"), F.col("canonical").alias("__by_full"))
    name = aliases.select(F.col("raw").alias("__name"), F.col("canonical").alias("__by_name"))
    joined = commits.join(full, F.col("author") == F.col("__full"), "left").join(name, name_only(F.col("author")) == F.col("__name"), "left")
    return joined.withColumn("author", F.coalesce("__by_full", "__by_name", name_only(F.col("author")))).drop(
        "__full", "__by_full", "__name", "__by_name"
    )


def with_handle(authors: DataFrame, handles: DataFrame) -> DataFrame:
    """``shown``: ``name (@handle)``; names that are handles themselves, and names without one, stay."""
    joined = authors.join(handles.select("name", "handle"), F.col("author") == F.col("name"), "left").drop("name")
    shown = F.when(F.col("author").startswith("@") | F.col("handle").isNull(), F.col("author"))
    return joined.withColumn("shown", shown.otherwise(F.concat("author", F.lit(" (@"), "handle", F.lit(")")))).drop("handle")


def with_old_names(commits: DataFrame, renames: DataFrame) -> DataFrame:
    """Commits of a module and, once more, those of its former name; one hop, a bag union."""
    moved = commits.join(renames.select(F.col("old").alias("module"), F.col("module").alias("__now")), "module")
    return commits.unionByName(moved.withColumn("module", F.col("__now")).drop("__now").select(*commits.columns))


def editors_line(stats: DataFrame, group: str, handles: DataFrame | None = None) -> DataFrame:
    """All authors of a group by latest activity, joined by ``", "``; with their handles if these are given."""
    rows = stats.withColumn("shown", F.col("author")) if handles is None else with_handle(stats, handles)
    order = F.struct((-F.coalesce(F.unix_timestamp("last_date"), F.lit(0))).alias("k"), F.col("author").alias("author"), "shown")
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["shown"]), ", ").alias("editors"))


def month_label(date: Column) -> Column:
    """``Jan 2020``; ``?`` without a date."""
    return F.coalesce(F.date_format(date, "MMM yyyy"), F.lit("?"))


def fill_placeholder(pages: DataFrame, sections: DataFrame, key: str, placeholder: str) -> DataFrame:
    """``body`` with the placeholder replaced by the page's section, if it has one that is not empty. Pages without the
    placeholder are never joined."""
    waiting = pages.filter(F.col("body").contains(placeholder)).join(sections.select(key, "section"), key, "left")
    done = F.when(F.length("section") > 0, F.replace("body", F.lit(placeholder), F.col("section"))).otherwise(F.col("body"))
    filled = waiting.withColumn("body", done).select(*pages.columns)
    return filled.unionByName(pages.filter(~F.coalesce(F.col("body").contains(placeholder), F.lit(False))))

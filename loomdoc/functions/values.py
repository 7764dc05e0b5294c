"""Flags, coercions, dates, labels and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a year of 365.25 days.
YEAR_SECONDS = 31_557_600


def shown(updated: Column, hidden: Column) -> Column:
    """Neither explicitly out of date nor hidden; a missing flag counts for the row."""
    return ~updated.eqNullSafe(F.lit(False)) & ~F.coalesce(hidden, F.lit(False))


def years_between(start: Column, end: Column) -> Column:
    """Full years of 365.25 days."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / YEAR_SECONDS).cast("long")


def short_date(c: Column) -> Column:
    return F.date_format(c, "MMM d, yyyy")


def feed_date(c: Column) -> Column:
    """An RFC 1123 date as a timestamp; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))


def iso_date(c: Column) -> Column:
    return c.try_cast("timestamp")


def json_or_empty(c: Column, schema: str) -> Column:
    """The parsed map; an empty one where the text is missing or invalid."""
    return F.coalesce(F.from_json(c, schema), F.from_json(F.lit("{}"), schema))


def default_literal(v: Column) -> Column:
    """``default`` without a value, a number as it is, other values in quotes."""
    quoted = F.concat(F.lit("'"), v, F.lit("'"))
    return F.when(v.isNull(), "default").when(v.try_cast("double").isNotNull(), v).otherwise(quoted)


def menu_label(name: Column, known: dict[str, str]) -> Column:
    """The known label of a page, else its name with spaces for hyphens, in title case: a capital wherever a word begins,
    behind any other sign than a letter."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    parts = F.regexp_extract_all(F.replace(name, F.lit("-"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.coalesce(F.try_element_at(table, name), F.array_join(F.transform(parts, F.initcap), ""))


def version_label(slug: Column) -> Column:
    return F.replace(slug, F.lit("-"), F.lit("."))


def first_by_status(releases: DataFrame, kept: list[str]) -> DataFrame:
    """How many releases (ord, status, series) each of the kept statuses has, and the first of them in order."""
    rows = releases.filter(F.col("status").isin(kept))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min_by("series", "ord").alias("first_series"))


def menu_json(entries: DataFrame, slug: Column) -> DataFrame:
    """(slug, items): a menu's entries (slug, label) as a JSON array of {label, slug}, by label."""
    ordered = F.array_sort(F.collect_list(F.struct("label", F.col("__slug").alias("slug"))))
    return entries.withColumn("__slug", slug).groupBy("slug").agg(F.to_json(ordered).alias("items"))


def run_counts(rows: DataFrame, group: str) -> DataFrame:
    """Of what a run had to do (ok, there) in each group: done, failed, and skipped as there was no input."""
    of = F.count_if
    return rows.groupBy(group).agg(
        of(F.col("there") & F.col("ok")).alias("ok"), of(F.col("there") & ~F.col("ok")).alias("failed"), of(~F.col("there")).alias("skipped")
    )


def in_locale_order(rows: DataFrame, group: str, name: str, tie: str) -> DataFrame:
    """``rn``: the place of each row of a group by its name as people sort names, not by code points."""
    order = Window.partitionBy(group).orderBy(F.collate(F.col(name), "UNICODE"), tie)
    return rows.withColumn("rn", F.row_number().over(order).cast("long"))

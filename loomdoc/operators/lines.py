"""Pages as ordered lines: numbering, runs, context, levels. All windows are within a page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(pages: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(key, more.., pos, line): lines split at ``\\n``, numbered from 0; a null text has none."""
    return pages.select(key, *more, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def in_order(key: str) -> Window:
    return Window.partitionBy(key).orderBy("pos")


def so_far(key: str) -> Window:
    return in_order(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def fenced(lines: DataFrame, key: str, is_fence: Column) -> DataFrame:
    """``in_fence``: the line is a fence or stands between an opening and a closing one."""
    n = F.sum(F.when(is_fence, 1).otherwise(0)).over(so_far(key))
    return lines.withColumn("in_fence", is_fence | (n % 2 == 1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def heading_parts(line: Column) -> Column:
    """struct(level, text, id) of a heading line from level 2 on, null for any other line. ``id`` is what stands in
    ``{#...}`` at its end, null without."""

    def told(bare: Column, level: Column, rest: Column) -> Column:
        own = F.substring_index(rest, "{#", -1)
        has_id = rest.contains("{#") & (F.instr(own, "}") == F.length(own)) & (F.length(own) > 1)
        text = F.when(has_id, F.rtrim(F.left(rest, F.length(rest) - F.length(own) - 2))).otherwise(rest)
        parts = F.struct(level.alias("level"), text.alias("text"), F.when(has_id, F.left(own, F.length(own) - 1)).alias("id"))
        return F.when(level.between(2, 6) & (F.substring(bare, level + 1, F.lit(1)) == " "), parts)

    def of_bare(bare: Column) -> Column:
        level = F.length(bare) - F.length(F.ltrim(bare, F.lit("#")))
        return let(level, lambda n: let(F.trim(F.substring(bare, n + 1, F.length(bare))), lambda rest: told(bare, n, rest)))

    return F.when(F.startswith(line, F.lit("##")), let(F.rtrim(F.regexp_replace(line, r"\s", " ")), of_bare))


def collapse_blank(lines: DataFrame, key: str) -> DataFrame:
    """Lines without blank ones that follow a blank one."""
    before = F.lag("line").over(in_order(key))
    return lines.withColumn("__before", before).filter((F.col("line") != "") | (F.coalesce("__before", F.lit("-")) != "")).drop("__before")


def islands(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """``island`` numbers the runs of equal ``value`` of a page from 1."""
    changed = ~value.eqNullSafe(F.lag(value).over(in_order(key))) | (F.row_number().over(in_order(key)) == 1)
    return rows.withColumn("island", F.sum(F.when(changed, 1).otherwise(0)).over(so_far(key)).cast("long"))


def carried_down(rows: DataFrame, key: str, name: str, value: Column) -> DataFrame:
    """``name``: the last ``value`` that is not null, the row's own included."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(so_far(key)))


def heading_context(headings: DataFrame, key: str) -> DataFrame:
    """``guide`` and ``section``: the nearest heading of level 2, and of level 3 since then."""
    two = F.when(F.col("level") == 2, F.col("text"))
    out = carried_down(headings, key, "guide", two)
    out = out.withColumn("__group", F.sum(F.when(F.col("level") == 2, 1).otherwise(0)).over(so_far(key)))
    inner = Window.partitionBy(key, "__group").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    three = F.when(F.col("level") == 3, F.col("text"))
    return out.withColumn("section", F.last(three, ignorenulls=True).over(inner)).drop("__group")


def ordinals(rows: DataFrame, key: str, kept: Column, name: str = "n") -> DataFrame:
    """Rows for which ``kept`` holds, numbered from 1 within a page."""
    return rows.filter(kept).withColumn(name, F.row_number().over(in_order(key)).cast("long"))


def numbered(rows: DataFrame, group: str, order: str, bucket: Column, name: str) -> DataFrame:
    """Rows numbered from 1 within a group by ``order``, which rises with ``bucket``: buckets are numbered one by one, and
    their counts give what is before them. So a group of any size is no single task's work."""
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(order))
    out = rows.withColumn("__place", place).join(counts, [group, "__bucket"])
    return out.withColumn(name, F.col("__place") + F.col("__before")).drop("__bucket", "__place", "__before")


def next_filled(rows: DataFrame, key: str) -> DataFrame:
    """``next_line``: the next line that is not blank; ``ahead``: the next seven lines, joined."""
    # From the end of the page, so that the frame grows and each row costs the same.
    after = Window.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    seven = in_order(key).rowsBetween(1, 7)
    filled = F.when(F.trim("line") != "", F.col("line"))
    out = rows.withColumn("next_line", F.last(filled, ignorenulls=True).over(after))
    return out.withColumn("ahead", F.array_join(F.collect_list("line").over(seven), "\n"))


def clamped_levels(levels: Column) -> Column:
    """Levels shifted so that the least is 2, then each at most one more than the one put out before (at first 1)."""
    shifted = F.transform(levels, lambda x: x - F.array_min(levels) + 2)
    start = F.struct(F.lit(1).alias("last"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, level: Column) -> Column:
        put = F.least(level, acc["last"] + 1)
        return F.struct(put.alias("last"), F.concat(acc["out"], F.array(put)).alias("out"))

    return F.aggregate(shifted, start, add, lambda acc: acc["out"])


def first_paragraph(text: Column, most: int) -> Column:
    """The first paragraph that is prose (no heading, list, table, quote or fence), on one line; cut with ``...``."""
    paragraphs = F.transform(F.split(text, "\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(p, "[ \t\r\n]+", " ")))
    prose = F.filter(paragraphs, lambda p: (p != "") & ~p.rlike(r"^([#*|>\-+]|```)"))
    first = F.try_element_at(prose, F.lit(1))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 3), F.lit("..."))).otherwise(first)


def in_document_order(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One list per page, in document order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", value)))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: x[value]).alias(name))

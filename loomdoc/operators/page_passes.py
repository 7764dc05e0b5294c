"""Passes over whole Markdown pages as rows of lines: callouts become asides, headings get their ids. A page comes in and a page
goes out; windows are within a page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdoc.functions import anchors, rules
from loomdoc.operators.lines import fenced, heading_context, heading_parts, in_order, islands, lines_of

FENCE = r"^\s*(```|~~~)"


def page_lines(pages: DataFrame, key: str, body: str, *more: str) -> DataFrame:
    """(key, more.., pos, line, in_fence) of the pages' lines."""
    return fenced(lines_of(pages, key, body, *more), key, F.col("line").rlike(FENCE))


def page_texts(lines: DataFrame, key: str, line: Column, body: str) -> DataFrame:
    """(key, body): lines put together again in their order; a null line goes."""
    ordered = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("pos", line.alias("line")))))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(body))


def asides(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body) of pages whose callouts are asides.

    A callout is a run of quote lines outside code whose first text is ``[!KIND]``. It becomes a container of the kind's aside
    with one quote mark less on each line; the head goes, and its line too if nothing else is on it. Quotes without a head,
    and quotes within quotes, stay as they are. A page without lines (a null body) has no row.
    """
    lines = page_lines(pages, key, body)
    quoted = ~F.col("in_fence") & F.col("line").rlike("^ {0,3}>")
    lines = islands(lines.withColumn("quoted", quoted), key, F.col("quoted"))
    lines = lines.withColumn("inner", F.regexp_replace("line", "^ {0,3}> ?", ""))
    run = Window.partitionBy(key, "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first("inner").over(run)
    kind = F.regexp_extract(head, r"^\[!([A-Z]+)\]", 1)
    lines = lines.withColumn("aside", F.when(F.col("quoted") & (kind != ""), rules.aside_of(kind)))
    lines = lines.withColumn("is_first", F.col("pos") == F.min("pos").over(run)).withColumn("is_last", F.col("pos") == F.max("pos").over(run))
    rest = F.ltrim(F.substring("inner", F.instr("inner", "]") + 1, F.length("inner")))
    opened = F.concat(F.lit(":::"), "aside", F.when(rest != "", F.concat(F.lit("\n"), rest)).otherwise(""))
    shown = F.when(F.col("is_first"), opened).otherwise(F.col("inner"))
    shown = F.concat(shown, F.when(F.col("is_last"), "\n:::").otherwise(""))
    return page_texts(lines, key, F.when(F.col("aside").isNotNull(), shown).otherwise(F.col("line")), body)


def told_apart(bases: list, own: list) -> list:
    """Ids of a page's headings in order: an own id is kept and taken; any other is the first free of ``x``, ``x_2`` ..."""
    used, following, out = set(), {}, []
    for base, explicit in zip(bases, own, strict=True):
        id_ = explicit or base
        while id_ and not explicit and id_ in used:
            following[base] = following.get(base, 1) + 1
            id_ = f"{base}_{following[base]}"
        used.add(id_)
        out.append(id_ or None)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _told_apart(bases: pd.Series, own: pd.Series) -> pd.Series:
    return pd.Series([told_apart(list(b), list(e)) for b, e in zip(bases, own, strict=True)], dtype=object)


def heading_lines(pages: DataFrame, key: str, body: str, *more: str) -> DataFrame:
    """Lines with level, text (as shown, without marks) and own id of headings, and the columns ``more`` of the pages."""
    lines = page_lines(pages, key, body, *more).withColumn("h", F.when(~F.col("in_fence"), heading_parts(F.col("line"))))
    shown = F.regexp_replace(F.regexp_replace("h.text", r"\[([^\]]*)\]\([^)]*\)", "$1"), "[`*]", "")
    return lines.select("*", F.col("h.level").alias("level"), F.nullif(F.trim(shown), F.lit("")).alias("text"), F.col("h.id").alias("own"))


def with_ids(lines: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body, ids): heading lines with their ids, told apart within the page: own ids and ``base`` where there is none."""
    head = F.struct("pos", "line", "level", F.col("h.text").alias("shown"), "base", "own")
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(head)).alias("x"))
    rows = rows.withColumn("ids", _told_apart(F.col("x.base"), F.col("x.own")))

    def put(x: Column, id_: Column) -> Column:
        headed = F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["shown"], F.lit(" {#"), id_, F.lit("}"))
        return F.when(id_.isNotNull() & x["level"].isNotNull(), headed).otherwise(x["line"])

    text = F.array_join(F.zip_with("x", "ids", put), "\n")
    return rows.select(key, text.alias(body), F.filter("ids", lambda i: i.isNotNull()).alias("ids"))


def module_heading_ids(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body, ids) of modules' pages: items of a section of exports have typed ids, other headings slugs. Own ids stay and
    are reserved from their place on, so an equal one before them stays too, and one behind them gets a number."""
    lines = heading_context(heading_lines(pages, key, body), key)  # lines without a level change no context
    base = F.nullif(anchors.item_id(F.col("level"), F.col("text"), F.col("section"), F.col("guide")), F.lit(""))
    return with_ids(lines.withColumn("base", F.when(F.col("level").isNotNull(), base)), key, body)


def manual_heading_ids(pages: DataFrame, key: str, page: str, body: str, ahead: int = 7) -> DataFrame:
    """(key, body, ids) of manuals' pages: a forced id goes before the rule of the page; pages without either keep their
    headings, and a page with forced ids alone keeps the others. Own ids stay and are reserved, as for modules."""
    lines = heading_lines(pages, key, body, page)
    behind = F.array_join(F.collect_list("line").over(in_order(key).rowsBetween(1, ahead)), "\n")
    lines = lines.withColumn("behind", behind)
    forced = rules.forced_id(F.col(page), F.col("text"))
    by_rule = F.when(rules.has_rule(F.col(page)), rules.manual_id(F.col(page), F.col("text"), F.col("behind")))
    lines = lines.withColumn("base", F.when(F.col("level").isNotNull() & F.col("text").isNotNull(), F.coalesce(forced, by_rule)))
    return with_ids(lines, key, body)

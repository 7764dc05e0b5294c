"""What filters of a corpus do to each other: every order of them, in long form.

A document's filters are the bits of a mask. Masks are counted by part; the few counted cells are unpivoted against the
steps of all orders; a running bit-or over the steps before tells whether a cell is gone by then; sums over a step, and over
a filter's steps in all orders, are the figures.

One pass over the texts leaves a row of numbers and a digest for each document. Two shuffles move these rows: one by doc_id,
for the labels, one by digest, for equal texts, combined before it so that a text with very many copies is a few rows.

Edge cases: a null text is empty, a null lang is the part ``""``; a row without a doc_id fails no comparison of ids and makes
no other row fail one; repeated rows are documents each, and of equal doc_id none is smaller; of several labels of a
document any 1 counts, labels of no document are left out; an empty table has no parts and gives no rows; other columns
are not read. Texts of any length are read whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.tables import load

QUERY = "op13_filter_audit"

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SIGNS = "#$%&*|"
SPACES = "\t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure condition of each filter that looks at one text alone."""
    words = F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), lambda w: w != "")
    n, length = F.size(words), F.length(text)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n.cast("long"),
        "C": 100 * (length - F.length(F.translate(text, CAPITALS, ""))).cast("long") > MOST_CAPITALS * length.cast("long"),
        "D": text.rlike(f"[{SIGNS}]"),
    }


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def document_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask, good, toxic, n): equal rows are one, with their number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = reduce(Column.__add__, (F.when(failed, bit(letter)).otherwise(0) for letter, failed in text_failures(text).items()))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    return rows.groupBy("doc_id", "part", "digest", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def with_repeats(rows: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): masks have the bit of E for each text that a smaller doc_id has too.

    Of a digest's rows, those of the least doc_id pass. Each task combines a digest's rows to one for each kind of row
    before they are shuffled, and the least over these kinds is a window over a handful of rows.
    """
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic", F.col("doc_id").isNull().alias("unknown")).agg(
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("first"), F.sum("n").alias("n")
    )
    least = F.min("least").over(Window.partitionBy("digest"))
    first = F.when(F.col("unknown"), F.col("n")).when(F.col("least") == least, F.col("first")).otherwise(0)
    kinds = kinds.withColumn("first", first)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    return kinds.select("part", "good", "toxic", F.explode(F.filter(both, lambda x: x["n"] > 0)).alias("x")).select("part", "good", "toxic", "x.*")


def cells(masks: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic) of rows (part, mask, good, toxic, n)."""
    return masks.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic")
    )


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of ``filters`` and step, of ``cells``. There are as many long rows as cells times steps of
    all orders: a number of the filters, not of the documents."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    long = counted.withColumn("filter_order", F.explode(orders)).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")
    )
    long = long.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    long = long.withColumn("own", F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.col("letter")) - 1))
    hit = F.col("mask").bitwiseAND(F.col("own"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("gone", F.coalesce(F.bit_or(hit).over(before), F.lit(0)) != 0).withColumn("fails", hit != 0)
    removed, total = F.col("fails") & ~F.col("gone"), lambda when, n: F.sum(F.when(when, F.col(n)).otherwise(0)).cast("long")
    steps = long.groupBy("part", "filter_order", "step", "letter").agg(
        total(~F.col("gone") & ~F.col("fails"), "n").alias("kept"),
        total(removed, "n").alias("removed"),
        total(F.col("fails") & F.col("gone"), "n").alias("redundant"),
        total(F.col("mask") == F.col("own"), "n").alias("unique_fails"),
        total(removed, "n_good").alias("good_lost"),
        total(removed, "n_toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_rows(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return audit(cells(with_repeats(rows)))


SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CAST(len(words) < 200 AS INT)
    + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
    + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS INT) AS mask
  FROM texts t LEFT JOIN marks m USING (doc_id)),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, own)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.own + b.own + c.own + d.own + e.own = 31 AND len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, letter, own,
    coalesce(sum(own) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM orders, range(1, 6) s(step), letters WHERE letter = substring(filter_order, step, 1)),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM masks GROUP BY ALL),
figures AS (
  SELECT part, filter_order, step, letter,
    CAST(coalesce(sum(n) FILTER (mask & CAST(earlier + own AS INT) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & CAST(earlier AS INT) = 0 AND mask & own <> 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & CAST(earlier AS INT) <> 0 AND mask & own <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n_good) FILTER (mask & CAST(earlier AS INT) = 0 AND mask & own <> 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n_toxic) FILTER (mask & CAST(earlier AS INT) = 0 AND mask & own <> 0), 0) AS BIGINT) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, letter)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM figures
"""

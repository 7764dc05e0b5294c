"""Case tables: an input and the result it must have, as templates over the rows of ``part``.

In a template «name» stands for a column of :func:`words`. A query makes every case of every row and runs the operator on
all; its SQL says what each must give.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.tables import load

Cases = dict[str, tuple[str, str]]

#: «name» two words, «first» and «second» of them, «kind» a word in capitals, «low» the same in lower case, «key» a number.
WORDS_SQL = """p AS (SELECT p_partkey, p_name AS name, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second,
  p_type AS kind, lower(p_type) AS low, CAST(p_partkey AS VARCHAR) AS key FROM part)"""


def tasks(spark: SparkSession) -> int:
    """As many as the session has for a shuffle, four for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` over as many tasks as the session has for a shuffle, four for each core at least. A scan has a
    task for so many bytes, and markup that is made of a row is far more work than its bytes tell."""
    return rows.repartition(tasks(rows.sparkSession), key)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.split("p_name", " ")
    return spread(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_partkey").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        part[0].alias("first"),
        part[1].alias("second"),
        F.col("p_type").alias("kind"),
        F.lower("p_type").alias("low"),
        F.col("p_partkey").cast("string").alias("key"),
    )


def filled(template: str) -> Column:
    """The template as an expression."""
    parts = re.split("«(\\w+)»", template)
    return F.concat(*[F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def filled_sql(template: str) -> str:
    parts = re.split("«(\\w+)»", template)
    return " || ".join(p if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p)


def inputs(spark: SparkSession, sf_dir: str, cases: Cases) -> DataFrame:
    """(p_partkey, rule, input, and the words): a row for each case of each row."""
    rules = F.array(*[F.struct(F.lit(rule).alias("rule"), filled(given).alias("input")) for rule, (given, _) in cases.items()])
    return words(spark, sf_dir).withColumn("__case", F.explode(rules)).select("*", "__case.*").drop("__case")


def wanted(cases: Cases) -> str:
    """SQL of (p_partkey, rule, output)."""
    parts = [f"SELECT p_partkey, {filled_sql(rule)} AS rule, {filled_sql(want)} AS output FROM p" for rule, (_, want) in cases.items()]
    return f"WITH {WORDS_SQL}\n" + "\nUNION ALL\n".join(parts)

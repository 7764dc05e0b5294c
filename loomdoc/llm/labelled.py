"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.shared import written


def held_out() -> Column:
    """Rows no model of this subpackage learns from: crc32 of the doc_id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def labelled_rows(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from; of several labels of a document the highest counts."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    return rows.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))


def label_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """How many documents have each label, before any bound."""
    return {r["label"]: r["n"] for r in labelled_rows(labels, label).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def sample(df: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """(text, label) of labelled rows that may be learnt from: of each class at most the given number, by a hash of
    doc_id. The sample's ids are broadcast, so ``most`` bounds what that sends. Kept in the shared folder."""
    rows = labelled_rows(labels, label)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    parts = [rows.filter(F.col("label") == value).orderBy(*order).limit(n) for value, n in most.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    ids = spark_table(chosen)
    return written(df.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label"), "sample")


def spark_table(small: DataFrame) -> DataFrame:
    """``small``, which has a stated bound, as a local table: its plan runs once."""
    return small.sparkSession.createDataFrame(small.toPandas(), small.schema)

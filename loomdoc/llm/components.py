"""Connected components by large-star and small-star steps, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.shared import drop, scratch_path, shuffles_dropped, written_at


def _to_least(edges: DataFrame, least_of: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least node next to u or u itself."""
    least = least_of.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    larger = both.filter(F.col("v") > F.col("u"))
    return _to_least(larger, both).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. Edges point from larger to smaller."""
    linked = _to_least(edges, edges)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    with shuffles_dropped(edges.sparkSession):
        row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that ``node`` reaches, for all nodes of ``edges`` (u, v) but the least ones.

    A round halves what is left to do or better, so rounds grow with the logarithm of the longest chain. Each round is
    written, and neither its shuffle files nor the round before are kept: there are many rounds, and files of few rows
    take a block of the disk each. Sums by node are combined before they are shuffled, and the joins are ones that Spark
    can split, so a node with very many links is no single task's work.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, "edges")
    edges = written_at(edges, path)
    before = _state(edges)
    while True:
        last, path = path, scratch_path(spark, "edges")
        edges = written_at(_small_star(_large_star(edges)), path)
        drop(spark, last)
        now = _state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now

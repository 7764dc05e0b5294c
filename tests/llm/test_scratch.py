"""What steps leave on the disk: their tables, and no shuffle files of jobs that have ended."""

import os
import time

from pyspark.sql import functions as F

from loomdoc.llm import shared
from loomdoc.llm.components import components


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for top in folders for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}


def left(spark, before):
    """Shuffle files that are new; Spark may take a moment to delete them."""
    for _ in range(20):
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return new


def test_written_tables_leave_no_shuffle_files(spark):
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = shuffle_files(spark)
    assert {(r["k"], r["count"]) for r in shared.written(counts, "counts").collect()} == {(k, 100) for k in range(10)}
    assert not left(spark, before)
    assert spark.conf.get(shared.DROP_SHUFFLES, None) is None


def test_components_leave_their_last_round_only(spark):
    """A chain of 400 and a star of 400: their least nodes, one table, no shuffle files."""
    chain = spark.range(400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    star = spark.range(1001, 1400).select(F.col("id").alias("u"), F.lit(1000).cast("long").alias("v"))
    before, point = shuffle_files(spark), shared.mark()
    found = components(chain.unionByName(star))
    assert not left(spark, before) and shared.mark() == point + 1
    assert {r["node"]: r["component"] for r in found.collect()} == {n: 0 for n in range(1, 401)} | {n: 1000 for n in range(1001, 1400)}

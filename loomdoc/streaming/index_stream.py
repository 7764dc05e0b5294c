"""Incremental upkeep of the anchor index: a stream of page maps folded into a stored index, batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loomdoc.operators.index import upsert_pages

SCHEMA = "section string, slug string, page string, ref string, id string"


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page maps as they arrive as Parquet files."""
    return spark.readStream.schema(SCHEMA).parquet(path)


#: Parts of the stored index; a batch rewrites only those that its pages are in.
BUCKETS = 64


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("section", "slug", "page"), F.lit(buckets)).cast("int")


def keep_index(arrivals: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """The index in ``folder``, in parts by a hash of its pages. Each batch merges its page maps into the parts they belong to
    and replaces those. A batch that is run again, after a failure at any point, leaves the same index."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", bucket_of(buckets))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most one row for each part
        old = spark.read.schema(f"{SCHEMA}, bucket int").option("ignoreMissingFiles", "true")
        try:
            before = old.parquet(folder).filter(F.col("bucket").isin(touched))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # else no batch has been stored yet
                raise
            before = spark.createDataFrame([], f"{SCHEMA}, bucket int")
        merged = upsert_pages(before, new, ["section", "slug", "page", "bucket"])
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)

    return arrivals.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

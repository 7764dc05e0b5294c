"""What the operators share: the folder all executors see, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: While it is set, Spark deletes the shuffle files of a query that ends. Else they stay until the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in local mode with the setting unset."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: this job needs a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomdoc-"))
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end within leave no shuffle files. For those whose result is stored: nobody reads their shuffles again."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: compact, and computed once."""
    return written_at(df, scratch_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    """Likewise, at ``path``. Shuffle files of the job go when it ends."""
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/loomdoc-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def mark() -> int:
    """A point in time, for ``drop_since``."""
    return len(_SCRATCH)


def drop_since(spark: SparkSession, point: int, keep: set[str]) -> None:
    """Delete the tables written since ``point``, but for ``keep``. For callers that stored what they made of them."""
    for path in _SCRATCH[point:]:
        if path not in keep:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of ``scratch_path`` that nothing reads any more."""
    delete(spark, path)
    _SCRATCH.remove(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables written so far. Only for callers whose earlier results are stored elsewhere."""
    while _SCRATCH:
        delete(spark, _SCRATCH.pop())


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

"""SimHash near-duplicates by multi-index hashing.

A table has each distinct fingerprint under its two segments of 32 bits. Two fingerprints that differ in at most two bits
differ in at most one bit of some segment, so each looks up the ball of radius 1 around each of its segments, and what the
table has there is held against it by the complete distance. Of two values that differ in a bit, the one that has it set
looks up the other, so a ball is the value itself and those with one bit cleared.

A segment value that more than ``CROWD`` fingerprints have (groups of near copies make such values) is not matched member
by member: whoever finds it enumerates balls in the other segment as well, that is, all fingerprints one bit away. Two
fingerprints differ in at most two bits exactly if they have one of these in common, and all that have one are linked to the
least doc_id among them. So a crowd of n makes some 65 n rows and never n * n. Components of these links are found on the
executors.

Edge cases: null and empty texts and texts of white space have the fingerprint zero, linked like any other; texts of fewer
words than a shingle are one shingle; repeated rows and equal doc_ids stay rows; rows with a null doc_id get the component
of their fingerprint, or null if no row with an id has it. Empty tables give empty results; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.llm.components import components
from loomdoc.llm.shared import written
from loomdoc.tables import load

QUERY = "op3_simhash"
SQL = None

WORDS, SEED = 3, 42
SEGMENT_BITS = 32
#: Links are at this distance or less: twice the radius of the balls.
DISTANCE = 2
#: Fingerprints that a segment value is matched with one by one.
CROWD = 32
#: Shingles hashed at once.
PART = 1 << 15


def shingle_hashes(text: str | None, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, repeats included, in parts of a bounded size."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return
    joined = b" ".join(parts)
    space = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], space + 1])[:n].tolist()
    ends = np.concatenate([space, [len(joined)]])[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, PART):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + PART], ends[i : i + PART], strict=True)], "<u8")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits: each set where over half of the text's shingle hashes have it."""
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = WORDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys.., fp) with fp as a signed 64-bit number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(found)], [*keys, "fp"])

    return df.select(*keys, "text").mapInArrow(of, "".join(f"{k} bigint, " for k in keys) + "fp bigint")


def segment_keys(values: Column, segment: int) -> Column:
    """Table keys of an array of values of a segment."""
    return F.transform(values, lambda v: v * 2 + segment)


def segments(fp: Column) -> list[Column]:
    return [fp.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)), F.shiftrightunsigned(fp, SEGMENT_BITS)]


def table_keys(fp: Column) -> Column:
    return F.concat(*[segment_keys(F.array(value), k) for k, value in enumerate(segments(fp))])


def ball_keys(fp: Column) -> Column:
    """Keys of the balls around both segments: each value, and each with one of its bits cleared."""
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(SEGMENT_BITS)])
    ball = lambda v: F.concat(F.array(v), F.transform(F.filter(bits, lambda m: v.bitwiseAND(m) != 0), lambda m: v.bitwiseXOR(m)))
    return F.concat(*[segment_keys(ball(value), k) for k, value in enumerate(segments(fp))])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def crowd_links(members: DataFrame) -> DataFrame:
    """(u, v): doc_ids of ``members`` (fp, rep) within reach, as stars around the least doc_id of what they have in common.

    65 fingerprints at most are one bit from another or equal to it, so no window is large.
    """
    masks = [0, *(1 << b for b in range(63)), -(1 << 63)]
    balls = members.select("fp", "rep", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    balls = balls.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("key"), "rep", "fp")
    hub = F.first(F.struct("rep", "fp")).over(Window.partitionBy("key").orderBy("rep"))
    found = balls.withColumn("hub", hub).filter((F.col("rep") != F.col("hub.rep")) & (distance(F.col("fp"), F.col("hub.fp")) <= DISTANCE))
    return found.select(F.col("rep").alias("u"), F.col("hub.rep").alias("v"))


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): doc_ids of ``distinct`` (fp, rep) whose fingerprints are linked, directly or by others of a crowd."""
    table = distinct.select(F.explode(table_keys(F.col("fp"))).alias("key"), F.col("fp").alias("other"), F.col("rep").alias("other_rep"))
    crowded = written(table.groupBy("key").count().filter(F.col("count") > CROWD).select("key"), "crowded")
    plain = table.join(crowded, "key", "left_anti")
    nothing = F.lit(None).cast("long")
    table = plain.unionByName(crowded.select("key", nothing.alias("other"), nothing.alias("other_rep")))
    probes = distinct.select(F.explode(ball_keys(F.col("fp"))).alias("key"), "fp", "rep")
    near = (F.col("fp") != F.col("other")) & (distance(F.col("fp"), F.col("other")) <= DISTANCE)
    hits = probes.join(table.hint("shuffle_hash"), "key").filter(F.col("other").isNull() | near)
    hits = written(hits.select("fp", "rep", "other_rep").distinct(), "hits")
    found = hits.filter("other_rep IS NOT NULL").select(F.col("rep").alias("u"), F.col("other_rep").alias("v"))
    return found.unionByName(crowd_links(hits.filter("other_rep IS NULL").select("fp", "rep")))


def near_duplicates(df: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach, the row's own included."""
    found = written(fingerprints(df, words), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    joined = components(links(distinct.filter("rep IS NOT NULL")))
    of_fp = distinct.join(joined, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return found.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def text_classes(df: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, class_id) of the distinct rows with a doc_id: texts are of one class if links lead from one to the
    other. ``text_hash`` tells rows of one doc_id apart, which are linked by their own texts only."""
    rows = df.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = written(fingerprints(rows, words, ("doc_id", "text_hash")).distinct(), "fingerprints")
    joined = components(links(written(found.select("fp", F.col("fp").alias("rep")).distinct(), "distinct")))
    return found.join(joined, F.col("fp") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("component", "fp").alias("class_id"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

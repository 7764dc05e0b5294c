"""Token-id files: canonical length-limited Huffman codes from global counts, in independent blocks.

A file set is a folder with two Parquet tables. ``codebook`` has the code length of each id; canonical codes follow from
it. ``blocks`` has blocks of whole documents in ascending doc_id order over all shards (files), each with ``start``, the
number of ids before it. In a block every document starts at a full byte and has a checkpoint, the bit offset of its code,
at each 64th id; stretches between checkpoints decode in step from one table. Blocks depend on the codebook alone.

Stages: tokenise and keep ids (two bytes each where they fit); count ids; order the keys by range, which gives each shard's
first key and size; code, and shuffle the codes by shard; sort each shard and write its blocks. A key is (doc_id, place in
the input), so rows of one doc_id, or of none, are dealt over shards as others are. The driver gets a count for each id of
the vocabulary and a row for each shard, of which there are ``MAX_SHARDS`` at most: beyond, shards grow, and Spark sorts
them on disk.

Edge cases: null and empty texts are the end id alone; long texts are blocks of their own; rows with equal doc_id
(repeats) are all kept, in the order of the input; a null doc_id comes first; an empty table gives empty files and an empty
result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import huffman
from loomdoc.llm.packing import tokenizer_path
from loomdoc.llm.shared import scratch_path, written
from loomdoc.llm.tokens import encoder
from loomdoc.tables import load

QUERY = "op10_token_files"
SQL = None

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
VOCABULARY = 50_257
#: Ids in a shard and in a block, about: a shard is sorted by one task, a block is decoded at once.
SHARD_IDS, BLOCK_IDS = 16_000_000, 1_000_000
MAX_SHARDS = 10_000
#: Ids that are coded at once, about.
CODED_IDS = 1 << 20

BLOCKS = "shard int, block int, start bigint, n_ids bigint, doc_ids array<bigint>, doc_n_ids array<bigint>, doc_bytes array<bigint>, marks binary, codes binary"


def width_of(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def binaries(data: np.ndarray | bytes, ends: np.ndarray) -> pa.Array:
    """``data`` in parts that end at bytes ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one value after another, and how many each has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def tokenise(df: DataFrame, path: str, end_id: int, vocabulary: int) -> DataFrame:
    """(doc_id, place, n_ids, ids): place orders all rows, ids are little-endian."""
    width = width_of(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, place = encoder(path, end_id, keeps_spaces=True, width=width), TaskContext.get().partitionId() << 33
        for batch in batches:
            row = 0
            for ids, n in coder.encode(batch["text"]):
                columns = [batch["doc_id"].slice(row, len(n)), pa.array(np.arange(place, place + len(n))), pa.array(n), binaries(ids, width * np.cumsum(n))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "n_ids", "ids"])
                row, place = row + len(n), place + len(n)

    return df.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, place bigint, n_ids bigint, ids binary")


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs, summed on the executors."""
    kind = f"<u{width_of(vocabulary)}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(vocabulary, np.int64)
        for batch in batches:
            totals += np.bincount(bytes_of(batch["ids"])[0].view(kind), minlength=vocabulary)
        keys = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(totals[keys])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for row in tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


class Shards:
    """The first key of each shard but the first, and the ids before each shard."""

    def __init__(self, tokens: DataFrame, shard_ids: int):
        total = tokens.agg(F.sum("n_ids")).first()[0] or 0
        n = min(max(1, -(-total // shard_ids)), MAX_SHARDS)
        found = []
        if n > 1:
            dealt = tokens.select("doc_id", "place", "n_ids").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "place")
            parts = dealt.withColumn("part", F.spark_partition_id()).groupBy("part")
            found = parts.agg(F.min(F.struct("doc_id", "place")).alias("first"), F.sum("n_ids").alias("n")).select("first.*", "n").collect()
        found = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["place"], r["n"]) for r in found)
        self.n_null = sum(not known for known, *_ in found[1:])
        self.ids, self.places = (np.array([f[k] for f in found[1:]], np.int64) for k in (1, 2))
        self.before = np.cumsum([0, *(f[3] for f in found[:-1])])

    def of(self, doc_ids: pa.Array, places: np.ndarray) -> np.ndarray:
        null, ids = doc_ids.is_null().to_numpy(zero_copy_only=False), doc_ids.fill_null(0).to_numpy()
        firsts, first_places = self.ids[self.n_null :], self.places[self.n_null :]
        low = np.searchsorted(firsts, ids, side="left")
        shard = np.searchsorted(firsts, ids, side="right")
        for i in np.flatnonzero(~null & (low < shard)).tolist():  # shards that begin within this doc_id
            shard[i] = low[i] + np.searchsorted(first_places[low[i] : shard[i]], places[i], side="right")
        shard += self.n_null
        shard[null] = np.searchsorted(self.places[: self.n_null], places[null], side="right")
        return shard


def write_files(df: DataFrame, folder: str, path: str, end_id: int, vocabulary: int, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> None:
    spark = df.sparkSession
    tokens = written(tokenise(df, path, end_id, vocabulary), "ids")
    shards = Shards(tokens, shard_ids)
    lengths = huffman.code_lengths(count_ids(tokens, vocabulary))
    used = np.flatnonzero(lengths)
    book = pd.DataFrame({"id": used, "length": lengths[used]}).astype("int64")
    spark.createDataFrame(book, "id bigint, length bigint").coalesce(1).write.parquet(f"{folder}/codebook")
    plan = spark.sparkContext.broadcast((lengths, huffman.canonical_codes(lengths), shards))
    width = width_of(vocabulary)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes, shards = plan.value
        for batch in batches:
            ends = np.cumsum(batch["n_ids"].to_numpy())
            for part in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // CODED_IDS)) + 1):
                some = batch.slice(part[0], len(part))
                n_ids = some["n_ids"].to_numpy()
                coded, at, marks, n_marks = huffman.encode(bytes_of(some["ids"])[0].view(f"<u{width}"), n_ids, lengths, codes)
                shard = pa.array(shards.of(some["doc_id"], some["place"].to_numpy()), pa.int32())
                columns = [shard, some["doc_id"], some["place"], some["n_ids"], binaries(marks, 4 * np.cumsum(n_marks)), binaries(coded, at[1:])]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "place", "n_ids", "marks", "codes"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, n, block, start, shard = [], 0, 0, None, 0

        def row() -> pa.RecordBatch:
            doc_id, n_ids, marks, codes = (list(x) for x in zip(*docs, strict=True))
            at = (np.cumsum([0, *map(len, codes)])[:-1]).tolist()
            values = dict(zip(schema.names, (shard, block, start, n, doc_id, n_ids, at, b"".join(marks), b"".join(codes)), strict=True))
            return pa.RecordBatch.from_pylist([values], schema)

        longs = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), longs, longs, longs, pa.binary(), pa.binary()]
        schema = pa.schema(list(zip((c.split()[0] for c in BLOCKS.split(", ")), kinds, strict=True)))
        for batch in batches:
            for s, *doc in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "n_ids", "marks", "codes")), strict=True):
                if start is None:
                    shard, start = s, int(plan.value[2].before[s])
                if docs and n + doc[1] > block_ids:
                    yield row()
                    docs, n, block, start = [], 0, block + 1, start + n
                docs.append(doc)
                n += doc[1]
        if docs:
            yield row()

    coded = tokens.mapInArrow(code, "shard int, doc_id bigint, place bigint, n_ids bigint, marks binary, codes binary")
    ordered = coded.repartitionById(len(shards.before), "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place")
    ordered.mapInArrow(gather, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_files(spark: SparkSession, folder: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, n_ids, ids): what the files hold, ids as little-endian unsigned 32-bit integers."""
    lengths = np.zeros(vocabulary, np.uint8)
    for row in spark.read.parquet(f"{folder}/codebook").collect():  # at most one row per id of the vocabulary
        lengths[row["id"]] = row["length"]
    plan = spark.sparkContext.broadcast(lengths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = huffman.Decoder(plan.value)
        for batch in batches:
            for i in range(len(batch)):
                n_ids, at = (batch[c][i].values.to_numpy() for c in ("doc_n_ids", "doc_bytes"))
                marks = np.frombuffer(batch["marks"][i].as_py(), "<u4")
                ids = decoder.decode(batch["codes"][i].as_py(), at, n_ids, marks).astype("<u4")
                ends = np.cumsum(n_ids)
                columns = [batch["doc_ids"][i].values, pa.array(batch["start"][i].as_py() + ends - n_ids), pa.array(n_ids), binaries(ids, 4 * ends)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_ids", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    return blocks.mapInArrow(decode, "doc_id bigint, start bigint, n_ids bigint, ids binary")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_files(load(spark, sf_dir, "documents"), folder, tokenizer_path(TOKENIZER), END_ID, VOCABULARY)
    found = read_files(spark, folder, VOCABULARY)
    crc = F.crc32(F.col("ids"))
    return found.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), crc.alias("ids_crc32"))

"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised once; a piece of exactly ``size`` ids is cut off the front as long as one fits, and the rest is
packed. Only the histogram of rest lengths (at most ``size`` numbers) reaches the driver. There lengths are placed longest
first, each into the open packs with the least used space that it fits, updating counts of packing patterns, never single
packs. A pattern that stands for n sequences owns n consecutive sequence ids and, for each of its lengths, n consecutive
ranks among the pieces of that length; a piece finds its sequence by its rank. Ranks come from counts of
(task, length), so no length, however common, is ranked in one task.

Edge cases: null and empty texts are the end id alone; a text of any length is cut into as many pieces as it needs; ties
in length are ranked by task and position; repeated rows are packed each; an empty table gives an empty result; extra
columns are not carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdoc.llm.shared import written
from loomdoc.llm.tokens import encoder
from loomdoc.tables import load

QUERY = "op9_packing"
SQL = None

SIZE, END_ID = 4096, 2
TOKENIZER = "word_bpe_49k.json"
PLACED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, rank bigint"


def numbered(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How often each value came before, ``seen`` (which is counted on) included."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(values)]
    begin = np.flatnonzero(first)
    number = np.empty(len(values), np.int64)
    number[order] = np.arange(len(values)) - np.repeat(begin, np.diff(np.append(begin, len(values)))) + seen[ordered]
    seen += np.bincount(values, minlength=len(seen))
    return number


def cut_pieces(df: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, rank): rank counts a length's pieces within a task from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = encoder(path, end_id, keeps_spaces=False), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            row = 0
            for ids, n in coder.encode(batch["text"]):
                doc = np.repeat(np.arange(len(n)), -(-n // size))
                start = numbered(doc, np.zeros(len(n), np.int64)) * size
                length = np.minimum(size, n[doc] - start)
                at = (np.cumsum(n) - n)[doc] + start
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [batch["doc_id"].take(pa.array(doc + row)), start, length, crc, n[doc], np.full(len(doc), task), numbered(length, seen)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])
                row += len(n)

    return df.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan_packs(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths longest first, number of packs) for each pattern; every piece of the histogram is in one.

    Shortest-pack-first: a length goes to the open packs with the most room, and into a new one if none has enough, as if
    pieces were packed one by one. Open patterns are kept by room, each as its last length and the pattern it was added to.
    """
    open_by_room: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    rooms: list[int] = []  # sorted; rooms that have patterns

    def put(room: int, pattern: tuple, n: int) -> None:
        if not open_by_room[room]:
            rooms.insert(bisect_left(rooms, room), room)
        open_by_room[room].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                # New packs, each with as many of this length as it holds, and one with what is left over.
                most = size // length
                for copies, n in ((most, left // most), (left % most, 1)):
                    if copies and n:
                        pattern = None
                        for _ in range(copies):
                            pattern = (length, pattern)
                        put(size - copies * length, pattern, n)
                break
            room = rooms[-1]
            pattern, n = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop()
            taken = min(n, left)
            if n > taken:
                put(room, pattern, n - taken)
            put(room - length, (length, pattern), taken)
            left -= taken
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for patterns in open_by_room.values():
        for pattern, n in patterns:
            lengths = []
            while pattern:
                length, pattern = pattern
                lengths.append(length)
            merged[tuple(reversed(lengths))] += n
    return sorted(merged.items())


def slots_of(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks from first to end go to consecutive sequences."""
    slots, next_rank, sequence = [], defaultdict(int), 0
    for pattern, n in packs:
        offset = 0
        for length in pattern:
            slots.append((length, next_rank[length], next_rank[length] + n, sequence, offset))
            next_rank[length] += n
            offset += length
        sequence += n
    return slots


def with_ranks(pieces: DataFrame) -> DataFrame:
    """``rank`` counts a length's pieces over all tasks."""
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "task")


def pack_documents(df: DataFrame, path: str | None = None, end_id: int = END_ID, size: int = SIZE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    One pass over the texts; the pieces are kept in the shared folder, since ranks need their counts first. Shuffles
    move rows of numbers only. The plan sent to the executors depends on ``size``, not on the data.
    """
    spark = df.sparkSession
    pieces = written(cut_pieces(df, path or tokenizer_path(TOKENIZER), end_id, size), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = np.array(slots_of(plan_packs(histogram, size)), np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    plan = spark.sparkContext.broadcast((np.searchsorted(slots[:, 0], np.arange(size + 2)), slots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_slot, slot = plan.value
        for batch in batches:
            rank, length = batch["rank"].to_numpy(), batch["length"].to_numpy()
            row = np.empty(len(rank), np.int64)
            for k in np.unique(length):
                mine = length == k
                first, end = first_slot[k], first_slot[k + 1]
                row[mine] = first + np.searchsorted(slot[first:end, 1], rank[mine], side="right") - 1
            found = {"sequence_id": slot[row, 3] + rank - slot[row, 1], "offset": slot[row, 4]}
            columns = [pa.array(found[c]) if c in found else batch[c] for c in PLACED]
            yield pa.RecordBatch.from_arrays(columns, list(PLACED))

    ranked = with_ranks(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return ranked.mapInArrow(place, ", ".join(f"{c} bigint" for c in PLACED))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))

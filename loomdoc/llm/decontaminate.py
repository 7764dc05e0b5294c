"""Benchmark decontamination: an FM-index per training shard, searched for the windows of the benchmark's items.

A task gathers documents to a shard of a bounded number of words, indexes it, and searches all windows of a block of items
by backward search; occurrences are located from sampled suffix positions and merged to spans. The index's alphabet is the
words of all items: any other word is a separator, and stretches between separators that are shorter than the shortest
window cannot hold one and are left out. Items come in blocks of a bounded size, each broadcast; a shard is indexed once and
searched for every block. Map-only over documents: nothing is shuffled.

Edge cases: null texts and texts without words have no windows and no hits; an item of fewer words than a window is one
window; items with equal ids count as one, items with a null id are not searched; a document of any length is one part of
a shard; repeated rows are judged one by one; empty tables give empty results or no hits; extra columns are not carried
by ``judge``, and are kept as they are by ``without_hits``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loomdoc.llm.fm_index import FMIndex
from loomdoc.llm.shared import LOWER
from loomdoc.tables import load

QUERY = "op4_decontaminate"
SQL = None

WINDOW = 10
#: Words in a shard (a longer document is one by itself) and bytes of text in a block of items.
SHARD_WORDS, BLOCK_BYTES = 1_000_000, 8_000_000

#: bytes.translate table: A-Z to lower case, what is no word byte to a space. Bytes over 127 are parts of words.
_WORDS = bytes(LOWER[c] if LOWER[c] > 0x7F or chr(LOWER[c]).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class Phrases:
    """The windows of a block of items; ``symbol`` numbers the words of all blocks, and grows."""

    def __init__(self, items: list[tuple], window: int, symbol: dict[bytes, int]):
        self.items = [item for item, _ in items]
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, text) in enumerate(items):
            ids = np.array([symbol.setdefault(w, len(symbol) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                rows = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                by_length.setdefault(rows.shape[1], []).append((rows, k))
        #: (length, phrases, first place in ``owners`` of each and the end, owners)
        self.groups = []
        for length, parts in sorted(by_length.items()):
            phrases, which = np.unique(np.concatenate([rows for rows, _ in parts]), axis=0, return_inverse=True)
            of = np.repeat([k for _, k in parts], [len(rows) for rows, _ in parts])
            pairs = np.unique(np.stack([which.reshape(-1), of]), axis=1)
            self.groups.append((length, phrases, np.searchsorted(pairs[0], np.arange(len(phrases) + 1)), pairs[1]))

    @property
    def shortest(self) -> int:
        return self.groups[0][0] if self.groups else 1 << 62


class Benchmark:
    """All items in blocks of a bounded size, each broadcast by itself, and the words of all of them.

    The driver holds one block's texts at a time. Executors read all blocks for each shard, so items are what has to fit them;
    documents are not.
    """

    def __init__(self, table: DataFrame, window: int, block_bytes: int):
        context, symbol, block, size = table.sparkSession.sparkContext, {}, [], 0
        self.blocks = []
        rows = table.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator()
        for row in rows:
            block.append((row["item_id"], row["text"]))
            size += len(row["text"])
            if size >= block_bytes:
                self.blocks.append(context.broadcast(Phrases(block, window, symbol)))
                block, size = [], 0
        if block:
            self.blocks.append(context.broadcast(Phrases(block, window, symbol)))
        self.symbol = context.broadcast(symbol)

    def search(self, shard: Shard) -> None:
        shard.search(self.symbol.value, [b.value for b in self.blocks])


class Shard:
    """Documents' words, one after another."""

    def __init__(self, texts: list):
        self.words = [words_of(t) for t in texts]
        self.n_words = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.n_words) - self.n_words
        self.hit = np.zeros(int(self.n_words.sum()), bool)
        self.items: list[set] = [set() for _ in texts]

    def search(self, symbol: dict[bytes, int], blocks: list[Phrases]) -> None:
        """Mark the words in occurrences of any phrase, and note whose they are. One index serves all blocks."""
        shortest = min((b.shortest for b in blocks), default=1 << 62)
        text = [np.zeros(1, np.int32)]
        for words in self.words:
            text.append(np.fromiter(map(symbol.get, words, repeat(0)), np.int32, len(words)))
            text.append(np.zeros(1, np.int32))
        text = np.concatenate(text)  # document d's word i is at starts[d] + i + d + 1
        cut = np.flatnonzero(text == 0)
        long_ = np.flatnonzero(np.diff(cut) > shortest)
        if not len(long_):
            return
        # The stretches that can hold a window, each with the separator before it.
        sizes = np.diff(cut)[long_]
        place = np.repeat(cut[long_] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        index = FMIndex(text[place], len(symbol) + 1)
        change = np.zeros(len(self.hit) + 1, np.int64)
        ends = np.cumsum(self.n_words + 1)  # of documents in ``text``, counted without the first separator
        for block in blocks:
            for length, rows, first_owner, owners in block.groups:
                first, end = index.search(rows)
                n = end - first
                if not n.sum():
                    continue
                which = np.repeat(np.arange(len(rows)), n)
                suffix = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = place[index.locate(suffix)] - 1
                doc = np.searchsorted(ends, at, side="right")
                word = at - doc
                np.add.at(change, word, 1)
                np.add.at(change, word + length, -1)
                for d, p in np.unique(np.stack([doc, which]), axis=1).T.tolist():
                    self.items[d].update(block.items[k] for k in owners[first_owner[p] : first_owner[p + 1]])
        self.hit |= np.cumsum(change[:-1]) > 0

    def n_hit(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.hit)])
        return total[self.starts + self.n_words] - total[self.starts]


def shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[tuple[pa.RecordBatch, int, Shard]]:
    """Rows with their shard, and which column has the texts; sizes are estimated at five bytes a word and never split a row."""
    rows, size = [], 0

    def gathered() -> tuple[pa.RecordBatch, int, Shard]:
        part = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        return part, at, Shard(part.column(at).to_pylist())

    for batch in batches:
        at = next(i for i, name in enumerate(batch.schema.names) if name.lower() == "text")
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        begin = 0
        for i, n in enumerate(lengths):
            if size and size + n > 5 * shard_words:
                rows.append(batch.slice(begin, i - begin))
                yield gathered()
                rows, size, begin = [], 0, i
            size += n
        rows.append(batch.slice(begin))
    if any(len(r) for r in rows):
        yield gathered()


def cleaned(text: str, hit: np.ndarray) -> str:
    """``text`` without what stands from the first to the last word of each run of hit words."""
    data = text.encode()
    word = np.frombuffer(data.translate(_WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1, strict=True):
        out.append(data[at : starts[a]])
        at = ends[b]
    return b"".join([*out, data[at:]]).decode()


def judge(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    items = Benchmark(benchmark, window, block_bytes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, shard in shards(batches, shard_words):
            items.search(shard)
            n_hit = shard.n_hit()
            found = {
                "doc_id": rows["doc_id"],
                "n_words": shard.n_words,
                "n_hit": n_hit,
                "n_items": np.array([len(s) for s in shard.items], np.int64),
                "items_sha256": [hashlib.sha256(",".join(sorted(map(str, s))).encode()).hexdigest() for s in shard.items],
                "contaminated": n_hit > 0,
            }
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.values()], list(found))

    return df.select("doc_id", "text").mapInArrow(
        of, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    )


def without_hits(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``df``, with the removal spans cut out of ``text``; other texts are untouched."""
    items = Benchmark(benchmark, window, block_bytes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at, shard in shards(batches, shard_words):
            items.search(shard)
            texts = rows.column(at).to_pylist()
            for i in np.flatnonzero(shard.n_hit()):
                a = shard.starts[i]
                texts[i] = cleaned(texts[i], shard.hit[a : a + shard.n_words[i]])
            columns = rows.columns
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return df.mapInArrow(of, df.schema)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))

"""How many tokens texts have, by two tiers of known pre-token lengths; no pre-token is ever shuffled.

A text is as many tokens as its pieces, cut where a byte-level tokenizer itself cuts (:func:`piece_starts`). The first tier
is a table of the frequent pieces and their lengths in tokens, sent to all workers once: Arrow looks up the distinct pieces
of a batch in it. What it lacks, a cache of the worker has, and what that lacks the tokenizers library encodes. Both tiers
hold whole pieces, not digests of them, so a count is never a guess: the tables decide the speed alone, and with empty ones
the counts are the same.

The frequent pieces are those of a random sample of rows (``SAMPLE_ROWS`` on average, ``FREQUENT`` pieces at most, each of
``LENGTH`` bytes at most): a table of some 2 MB, whatever the corpus. The sample's rows meet in a few tasks, which return
their own most frequent pieces only.

Edge cases: a null text is empty and has no token; texts of any length are read whole, a long one in parts; a special string
in a text is one token, as the library's default has it; repeated rows are counted each; a row without a doc_id is counted
too; an empty table gives an empty one. Columns of the input other than those asked for are not carried.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from loomdoc.llm.packing import tokenizer_path
from loomdoc.llm.tokens import _byte_letters, cuts
from loomdoc.tables import load

QUERY = "op12_token_counts"

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512

#: Rows sampled on average, tasks they meet in, pieces of the table and their bytes.
SAMPLE_ROWS, SAMPLE_TASKS, FREQUENT, LENGTH = 2048, 8, 32_768, 48
#: Pieces that a worker's cache holds, and their bytes: some 60 MB.
CACHED, CACHED_LENGTH = 300_000, 64
#: Bytes of text that are cut at once, about.
AT_ONCE = 8 << 20

#: White space outside ASCII, in UTF-8: fixed values of Unicode.
_ODD_SPACE = re.compile("|".join(re.escape(chr(c).encode().decode("latin-1")) for c in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]).encode("latin-1"))
#: Where a text can be parted whatever stands elsewhere: before a single space between visible characters.
_PART = re.compile(rb"(?<=[!-~]) (?=[!-~])")
#: A pre-token of one kind of characters; the library's model takes it without looking for others.
_PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@[-`{-~]+)")


def piece_starts(data: np.ndarray, starts: np.ndarray, specials: re.Pattern | None) -> np.ndarray:
    """Where the pieces of ``data`` begin; texts begin at ``starts`` (none is empty).

    A special string is a piece, and what stands at its sides is cut as if it were a text of its own. From the last place
    before an odd white space where a text can be parted, to the next one behind it, is one piece.
    """
    text = data.tobytes()
    marks = np.array([x for m in specials.finditer(text) for x in m.span()] if specials else [], np.int64).reshape(-1, 2)
    marks = marks[np.searchsorted(starts, marks[:, 0], side="right") == np.searchsorted(starts, marks[:, 1], side="left")].ravel()  # not over two texts
    bounds = np.unique(np.concatenate([starts, marks[marks < len(data)]])).astype(np.int64)
    found = cuts(data, bounds, np.zeros(len(bounds), bool))
    drop = [marks.reshape(-1, 2)]  # cuts within a special string
    odd = np.array([m.start() for m in _ODD_SPACE.finditer(text)], np.int64)
    if len(odd):
        visible = (data >= 0x21) & (data <= 0x7E)
        parted = np.flatnonzero((data[1:-1] == 0x20) & visible[:-2] & visible[2:]) + 1
        parted = np.append(np.union1d(parted, bounds), len(data))
        at = np.searchsorted(parted, odd, side="right")
        drop.append(np.unique(np.column_stack([parted[at - 1], parted[at]]), axis=0))
    for spans in drop:
        if len(spans):
            last = np.searchsorted(spans[:, 0], found, side="left") - 1
            found = found[(last < 0) | (found >= spans[np.maximum(last, 0), 1])]
    return found


class TokenCounter:
    """Lengths in tokens of pieces and texts, for a byte-level tokenizer of the tokenizers library."""

    def __init__(self, path: str, frequent: pa.Array, lengths: np.ndarray, cached: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, ByteLevel):
            raise ValueError(f"{path} is not a byte-level tokenizer")
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        added = [str(t) if isinstance(t, str) else t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        added.sort(key=len, reverse=True)
        self.added = {t.encode() for t in added}
        self.specials = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        self.frequent, self.lengths = frequent, lengths
        self.cache: dict[bytes, int] = {}
        self.cached = cached

    def of_pieces(self, pieces: pa.Array) -> np.ndarray:
        """The lengths of distinct pieces."""
        slot = pc.fill_null(pc.index_in(pieces, value_set=self.frequent), -1).to_numpy(zero_copy_only=False)
        out = np.zeros(len(pieces), np.int64)
        out[slot >= 0] = self.lengths[slot[slot >= 0]]
        rest = np.flatnonzero(slot < 0)
        words = pieces.take(pa.array(rest)).to_pylist()
        found = list(map(self.cache.get, words))
        missing = [w for w, n in zip(words, found, strict=True) if n is None]
        new: dict[bytes, int] = {}
        others = []
        for w in missing:
            if w not in self.added and _PLAIN.fullmatch(w):
                new[w] = len(self.model.tokenize(w.decode("latin-1").translate(self.letters)))
            else:
                others.append(w)
        for i in range(0, len(others), 1024):
            part = others[i : i + 1024]
            encoded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            new.update(zip(part, map(len, encoded), strict=True))
        out[rest] = [new[w] if n is None else n for w, n in zip(words, found, strict=True)]
        if len(self.cache) + len(new) > self.cached:
            self.cache.clear()  # frequent pieces are in the first tier, so little is lost
        self.cache.update((w, n) for w, n in new.items() if len(w) <= CACHED_LENGTH)
        return out

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
        begin = piece_starts(data, starts, self.specials)
        bounds = np.append(begin, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        return begin, pieces.dictionary_encode()

    def parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, starts, rows) of texts that are not empty, some at once; a long text comes in parts of its own."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        row = 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + AT_ONCE, side="right")) - 1)
            part = offsets[row : last + 1]
            if part[-1] - part[0] > 2 * AT_ONCE:  # one text
                text, a = data[part[0] : part[-1]].tobytes(), 0
                while a < len(text):
                    found = _PART.search(text, a + AT_ONCE)
                    b = found.start() if found else len(text)
                    yield np.frombuffer(text[a:b], np.uint8), np.zeros(1, np.int64), np.array([row])
                    a = b
            elif part[-1] > part[0]:
                filled = np.flatnonzero(part[1:] > part[:-1])
                yield data[part[0] : part[-1]], part[filled] - part[0], filled + row
            row = last

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        n = np.zeros(len(texts), np.int64)
        for data, starts, rows in self.parts(texts):
            begin, coded = self._pieces(data, starts)
            of_piece = self.of_pieces(coded.dictionary)[coded.indices.to_numpy()]
            n[rows] += np.add.reduceat(of_piece, np.searchsorted(begin, starts))
        return n


def frequent_pieces(df: DataFrame, path: str, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> tuple[pa.Array, np.ndarray]:
    """The frequent pieces of a sample of ``df``'s texts and their lengths in tokens."""
    empty = pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    total = df.count()
    if not total or not most:
        return empty

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = TokenCounter(path, *empty), Counter()
        for batch in batches:
            for data, starts, _ in counter.parts(batch["text"]):
                coded = counter._pieces(data, starts)[1]
                times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist()
                for piece, k in zip(coded.dictionary.to_pylist(), times, strict=True):
                    if len(piece) <= LENGTH:
                        seen[piece] += k
            if len(seen) > 8 * most:  # what is rare so far goes
                seen = Counter(dict(seen.most_common(4 * most)))
        best = seen.most_common(most)
        lengths = counter.of_pieces(pa.array([w for w, _ in best], pa.large_binary()))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([k for _, k in best], pa.int64()), pa.array(lengths)], ["piece", "times", "length"])

    part = df.select("text").sample(min(1.0, rows / total), 17) if total > rows else df.select("text")
    found = part.repartition(SAMPLE_TASKS).mapInArrow(counted, "piece binary, times bigint, length bigint").toArrow()  # SAMPLE_TASKS * most rows at most
    best = found.group_by(["piece", "length"]).aggregate([("times", "sum")]).sort_by([("times_sum", "descending"), ("piece", "ascending")]).slice(0, most)
    return best["piece"].combine_chunks().cast(pa.large_binary()), best["length"].to_numpy()


#: The counter of this Python worker by the job it is for; its cache outlives a task.
_COUNTERS: dict[str, TokenCounter] = {}


def _counter(job: str, path: str, table) -> TokenCounter:
    if job not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[job] = TokenCounter(path, *table.value)
    return _COUNTERS[job]


def count_tokens(df: DataFrame, keep: Sequence[str] = ("doc_id",), path: str | None = None, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> DataFrame:
    """The columns ``keep`` of ``df`` with n_bytes (UTF-8) and n_tokens of its ``text``. Map-only but for the sample."""
    path = path or tokenizer_path(TOKENIZER)
    table = df.sparkSession.sparkContext.broadcast(frequent_pieces(df, path, rows, most))
    job, keep = uuid.uuid4().hex, list(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(job, path, table)
        for batch in batches:
            n = counter.count(batch["text"])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), batch["n_bytes"], pa.array(n)], [*keep, "n_bytes", "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    texts = df.select(*keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return texts.mapInArrow(count, f"{kinds}, n_bytes bigint, n_tokens bigint")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(load(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


#: A tokenizer has no SQL; tests hold the counts against the library.
SQL = None

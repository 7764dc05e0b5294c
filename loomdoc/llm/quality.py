"""Quality rules: base rules, then gradient-boosted trees over document statistics.

Statistics come from whole texts in one map-only pass. The trees are fitted on the driver on a sample of at most
``SAMPLE`` labelled documents of each class (a fixed bound) and scored in flat numpy arrays. The score may only fall with
the shares of symbols, repeated words and duplicate lines.

Edge cases: null and empty texts have no words and fail the base rules; texts of any length are read whole; repeated rows
are judged one by one; with no labels, or labels of one class only, the trees keep all that passes the base rules; an empty
table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomdoc.llm import gbt
from loomdoc.llm.labelled import sample
from loomdoc.tables import load

QUERY = "op5_quality"
SQL = None

#: Labelled documents of each class that are learnt from, at most.
SAMPLE = 5_000
#: Documents that score lower are dropped.
LEAST_SCORE = 0.5
WINDOW = 5
#: Base rules: fewest words, and most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 10, 20

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
DIGITS, STOPS, CALLS = b"0123456789", b".,;:", b"!?"
#: Features, and the direction in which each may move the score.
FEATURES = {
    "log_words": 0,
    "mean_chars": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "capital_share": 0,
    "digit_share": 0,
    "stop_share": 0,
    "call_share": 0,
    "distinct_share": 0,
    "words_per_line": 0,
    "short_word_share": 0,
}
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which the text has twice or more. Windows are compared by 64-bit mixtures of hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h ^= h >> np.uint64(29)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ (mixed >> np.uint64(31))) + h[k : n + k] * _MIX[k % len(_MIX)]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    found = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """The base counts, then the features."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    without = lambda what: len(data) - len(data.translate(None, what))
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = len(text or "") - (len(data) - sum(map(len, words)))
    symbols, repeated = without(SYMBOLS), repeated_words(words)
    n_dup = len(lines) - len(set(lines))
    per_char, per_word, per_line = max(chars, 1), max(n, 1), max(len(lines), 1)
    short = sum(len(w) < 4 for w in words)
    return (
        n,
        chars,
        symbols,
        n_dup,
        repeated,
        np.log1p(n),
        chars / per_word,
        symbols / per_char,
        n_dup / per_line,
        repeated / per_word,
        without(CAPITALS) / per_char,
        without(DIGITS) / per_char,
        without(STOPS) / per_word,
        without(CALLS) / per_word,
        len(set(words)) / per_word,
        n / per_line,
        short / per_word,
    )


def fit(df: DataFrame, labels: DataFrame, most: int = SAMPLE) -> gbt.Trees | None:
    """Trees for the probability of label 1, or None if the sample has one class only."""
    rows = sample(df, labels, "quality", {0: most, 1: most})
    names = list(FEATURES)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [statistics(t)[len(BASE) :] for t in batch["text"]]
            yield pd.DataFrame(found, columns=names).assign(label=batch["label"].to_numpy())

    table = rows.mapInPandas(of, ", ".join(f"{c} double" for c in names) + ", label int").toPandas()
    table = table.sort_values([*names, "label"])  # the same trees whatever order the executors answer in
    y = table["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    return gbt.fit(table[names].to_numpy(), y, list(FEATURES.values()))


def judge(df: DataFrame, trees: gbt.Trees | None, least_score: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, the base counts, base_failed, score, kept)."""
    model = df.sparkSession.sparkContext.broadcast(trees)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = np.array([statistics(t) for t in batch["text"].to_pylist()], float)
            found = dict(zip(BASE, rows[:, : len(BASE)].astype(np.int64).T, strict=True))
            failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
            score = model.value.score(rows[:, len(BASE) :]) if model.value is not None else np.ones(len(rows))
            found = {"doc_id": batch["doc_id"], **found, "base_failed": failed, "score": score, "kept": ~failed & (score >= least_score)}
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.values()], list(found))

    counts = ", ".join(f"{c} bigint" for c in BASE)
    return df.select("doc_id", "text").mapInArrow(of, f"doc_id bigint, {counts}, base_failed boolean, score double, kept boolean")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return judge(documents, fit(documents, load(spark, sf_dir, "labels")))



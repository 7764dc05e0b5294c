"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding: lower case; letters that look like Latin ones become those; digits and signs that stand for letters inside a word
become letters. The lexicon holds whole words and beginnings of words, with weights, and is learnt from labelled documents:
of each class at most ``SAMPLE`` (a fixed bound) is read. A term counts where a word begins (a whole word also has to end
there), unless it is part of an exception phrase: a word, or a pair of neighbouring words, that the sample has in documents
without the label only or mostly. The sum of the weights, normalised by the length of the text, goes through a logistic
curve fitted on the same sample. Scoring is map-only; labels, lang, source and doc_id are no inputs of it.

Edge cases: null and empty texts have no terms and get the score of no evidence; texts of any length are matched whole;
repeated rows get equal scores; with no labels or one class only every score is 0; an empty table gives an empty result;
extra columns are not carried by ``score``, and are kept as they are by ``without_toxic``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.labelled import held_out, label_counts, sample
from loomdoc.llm.shared import written
from loomdoc.tables import load

QUERY = "op7_toxicity"
SQL = None

#: The curve's base at most: a text without evidence scores a tenth or less.
NO_EVIDENCE = -2.2
#: Labelled documents of each class that are learnt from, at most: {label: number}.
SAMPLE = {1: 4_000, 0: 12_000}
THRESHOLD = 0.3


@dataclass(frozen=True)
class Terms:
    """What a lexicon may hold. None of it bounds the texts that are scored."""

    #: Shortest and longest beginning of a word, and most characters of a whole word. A longer word is its beginnings.
    prefix: tuple[int, int] = (3, 9)
    word: int = 24
    #: Terms of the sample that are looked at, those in most labelled documents first, and terms chosen, at most.
    looked_at: int = 6_000
    chosen: int = 400
    #: A term is in so many labelled documents at least, and at most this share of its documents lack the label.
    least_docs: int = 4
    most_clean: float = 0.2
    #: Terms are chosen until each labelled document that can be has so many; a document without the label counts so many
    #: times against a term, when both classes have the same weight.
    cover: int = 4
    against: int = 3
    #: Hits of one term that add to a text's evidence; None: all.
    repeats: int | None = 4



# Letters that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
    "ⅼ": "l", "ո": "n", "ս": "u", "օ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_FOLD, _LOOKALIKE = str.maketrans(LOOKALIKES), re.compile("[" + "".join(LOOKALIKES) + "]")
_SIGNS, _UNFOLD = re.compile(r"[0-9]+|[@$!]"), str.maketrans(DIGITS)
_LETTER = re.compile(r"[^\W\d_]")
_TOKEN = re.compile(r"[^\W\d_]+")


def _letters(m: re.Match) -> str:
    """Digits next to a letter, and a sign between two, as the letters they stand for."""
    text, (a, b) = m.string, m.span()
    left, right = a > 0 and text[a - 1].isalpha(), b < len(text) and text[b].isalpha()
    inside = (left or right) if text[a].isdigit() else (left and right)
    return m[0].translate(_UNFOLD) if inside else m[0]


def fold(text: str | None) -> str:
    """Lower case, without disguises of letters. Numbers by themselves stay."""
    if not text:
        return ""
    text = text.lower()
    if _LOOKALIKE.search(text):
        text = text.translate(_FOLD)
    return _SIGNS.sub(_letters, text)


def terms_of(folded: str, limits: Terms = Terms()) -> set[str]:  # noqa: B008
    """Whole words as ``word$`` and beginnings of words as ``begin``."""
    out = set()
    for w in set(_TOKEN.findall(folded)):
        if limits.prefix[0] <= len(w) <= limits.word:
            out.add(w + "$")
        out.update(w[:k] for k in range(limits.prefix[0], min(limits.prefix[1], len(w)) + 1))
    return out


@dataclass
class Lexicon:
    """Weights by term, exception phrases (words and pairs of words), and the curve's base and slope."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set = field(default_factory=set)
    base: float = -50.0
    slope: float = 0.0
    repeats: int | None = Terms.repeats

    def automaton(self):
        found = ahocorasick.Automaton()
        for term in self.weights:
            bare = term.rstrip("$")
            before = found.get(bare, ())
            found.add_word(bare, (*before, term))
        found.make_automaton()
        return found

    def hits(self, folded: str, automaton) -> Iterator[tuple[str, str, str, str]]:
        """(term, the word it is in, the word before, the word after) of each hit that no exception takes away."""
        if not self.weights:
            return
        words, starts = None, []
        for end, terms in automaton.iter(folded):
            start = end + 1 - len(terms[0].rstrip("$"))
            if start and _LETTER.match(folded[start - 1]):
                continue
            if words is None:  # most texts have no hit
                found = list(_TOKEN.finditer(folded))
                words, starts = [m[0] for m in found], [m.start() for m in found]
            i = bisect_left(starts, start)
            word = words[i]
            before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
            if self.exceptions.intersection((word, (before, word), (word, after))):
                continue
            for term in terms:
                if term[-1] != "$" or start + len(word) == end + 1:
                    yield term, word, before, after

    def evidence(self, text: str | None, automaton) -> float:
        """Sum of the weights of a text's hits (a term ``repeats`` times at most), over the logarithm of its length."""
        folded = fold(text)
        counts = Counter(term for term, *_ in self.hits(folded, automaton))
        total = sum(self.weights[t] * (n if self.repeats is None else min(n, self.repeats)) for t, n in counts.items())
        return total / np.log2(16 + len(folded) / 64)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * evidence, -50, 50)))


def _counted(rows: DataFrame, schema: str, of) -> DataFrame:
    """Counts by (label, key) that each task makes of its texts, summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                found.update((label, key) for key in of(fold(text)))
        yield pd.DataFrame([(*key, n) for key, n in found.items()], columns=["label", "key", "n"]).astype({"label": "int32", "n": "int64"})

    return rows.mapInPandas(count, schema).groupBy("label", "key").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, labels: DataFrame, most: dict[int, int] = SAMPLE, limits: Terms = Terms()) -> Lexicon:  # noqa: B008
    """The lexicon of the sample. What reaches the driver is bounded by ``most`` and ``limits``."""
    rows = sample(df, labels, "toxic", most).filter("text IS NOT NULL").dropDuplicates(["text"])
    rows = written(rows.repartition(16, F.xxhash64("text")), "distinct")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return Lexicon()
    schema, context = "label int, key string, n bigint", df.sparkSession.sparkContext
    toxic = _counted(rows.filter("label = 1"), schema, lambda folded: terms_of(folded, limits)).filter(F.col("n") >= limits.least_docs)
    in_toxic = {r["key"]: r["n"] for r in toxic.orderBy(F.desc("n"), "key").limit(10 * limits.looked_at).collect()}
    known = context.broadcast(frozenset(in_toxic))
    clean = _counted(rows.filter("label = 0"), schema, lambda folded: terms_of(folded, limits) & known.value)
    in_clean = {r["key"]: r["n"] for r in clean.collect()}
    share = size[1] / size[0]  # so that classes of any size in the sample weigh alike
    pure = [t for t, n in in_toxic.items() if (c := in_clean.get(t, 0) * share) <= limits.most_clean * (n + c)]
    # Whole words before beginnings, long before short, where both cover the same.
    looked_at = sorted(pure, key=lambda t: (-in_toxic[t], t[-1] != "$", -len(t), t))[: limits.looked_at]
    chosen = _chosen(rows.filter("label = 1"), looked_at, [limits.against * share * in_clean.get(t, 0) for t in looked_at], limits)
    odds = lambda t: np.log((in_toxic[t] + 0.5) / size[1]) - np.log((in_clean.get(t, 0) + 0.5) / size[0])
    lexicon = Lexicon({t: float(odds(t)) for t in chosen}, repeats=limits.repeats)
    lexicon.exceptions = _exceptions(rows, lexicon, share)
    return _calibrated(rows, lexicon, size, label_counts(labels, "toxic"))


def _chosen(toxic: DataFrame, looked_at: list[str], against: list[float], limits: Terms) -> list[str]:
    """Greedy cover: the term that gains most documents which have too few, less what is against it, again and again. A term that begins like a
    chosen one, or the other way round, is that term's shadow and goes."""
    place = toxic.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(looked_at)})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [sorted(i for t in terms_of(fold(text), limits) if (i := place.value.get(t)) is not None) for text in batch["text"]]
            yield pd.DataFrame({"terms": rows})

    has = [r["terms"] for r in toxic.select("text").mapInPandas(of, "terms array<int>").toLocalIterator()]
    matrix = np.zeros((len(has), len(looked_at)), bool)
    for i, terms in enumerate(has):
        matrix[i, terms] = True
    alive, cover, out = np.ones(len(looked_at), bool), np.zeros(len(has), int), []
    bare = [t.rstrip("$") for t in looked_at]
    while len(out) < limits.chosen:
        gain = np.where(alive, matrix[cover < limits.cover].sum(axis=0) - np.array(against), 0)
        if not len(gain) or gain.max() < limits.least_docs:
            break
        best = int(gain.argmax())  # the first of equals, see looked_at
        out.append(looked_at[best])
        cover += matrix[:, best]
        alive &= [not (b.startswith(bare[best]) or bare[best].startswith(b)) for b in bare]
    return out


def _exceptions(rows: DataFrame, lexicon: Lexicon, share: float) -> set:
    """Words and pairs of words around hits that are mostly in documents without the label (two of them at least)."""

    def of(folded: str) -> set[str]:
        automaton = _automaton(lexicon)
        return {k for _, w, a, b in lexicon.hits(folded, automaton) for k in (w, f"{a} {w}", f"{w} {b}")}

    counts: dict[str, list[int]] = {}
    for r in _counted(rows, "label int, key string, n bigint", of).filter("n > 1").toLocalIterator():
        counts.setdefault(r["key"], [0, 0])[r["label"]] = r["n"]
    bad = {k for k, (clean, toxic) in counts.items() if clean >= 2 and clean * share > toxic}
    return {tuple(k.split(" ")) if " " in k else k for k in bad}


def _automaton(lexicon: Lexicon):
    """The lexicon's automaton, made once in a process."""
    if "_made" not in lexicon.__dict__:
        lexicon._made = lexicon.automaton()
    return lexicon._made


def _calibrated(rows: DataFrame, lexicon: Lexicon, size: dict[int, int], labelled: dict[int, int]) -> Lexicon:
    """The lexicon with a logistic curve through the sample's evidence (a row for each document of the bounded sample).

    The sample is bounded for each class, so its shares are not those of the labels: the curve's base is moved by the
    difference of their odds. A text without any evidence stays under the threshold, whatever the shares are.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pd.DataFrame({"evidence": [lexicon.evidence(t, automaton) for t in batch["text"]], "label": batch["label"]})

    found = rows.select("text", "label").mapInPandas(of, "evidence double, label int").toPandas().sort_values(["evidence", "label"])
    x, y = found["evidence"].to_numpy(), found["label"].to_numpy(float)
    base, slope = float(np.log(size[1] / size[0])), 0.0
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(base + slope * x, -30, 30)))
        v = p * (1 - p) + 1e-6
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + 0.1 * slope])
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        base, slope = base - step[0], slope - step[1]
        if np.abs(step).max() < 1e-8:
            break
    base += np.log(labelled[1] / labelled[0]) - np.log(size[1] / size[0])
    lexicon.base, lexicon.slope = float(min(base, NO_EVIDENCE)), float(max(slope, 0.0))
    return lexicon


def _scorer(df: DataFrame, lexicon: Lexicon):
    """A pandas UDF from text to score."""
    lexicon.__dict__.pop("_made", None)
    model = df.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.value.automaton()
        for texts in batches:
            yield pd.Series(model.value.probability(np.array([model.value.evidence(t, automaton) for t in texts], float)))

    return score


def score(df: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    rows = df.select("doc_id", held_out().alias("held_out"), _scorer(df, lexicon)(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(df: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score lower than the threshold, with all columns of ``df``."""
    return df.filter(_scorer(df, lexicon)(F.col("text")) < threshold)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return score(documents, learn(documents, load(spark, sf_dir, "labels")))

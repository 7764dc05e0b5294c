"""Token counts against the tokenizers library on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomdoc.llm import token_counts
from loomdoc.llm.packing import tokenizer_path
from tests.llm import brute

PATH = tokenizer_path(token_counts.TOKENIZER)
NONE = pa.array([], pa.large_binary()), np.zeros(0, np.int64)
SNIPPETS = [
    "a", "b", "Zz", " ", "  ", "\n", "\t", " ", " ", "　", " ", "1", "23", "'s", "'", "!?", "<|endoftext|>", "<|endof", "text|>",
    "é", "ив", "张", "\x1c", "\x85", " a b ", " x y z ", "\U0001f600", "́",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_any_mixture(library):
    rng = random.Random(3)
    texts = ["".join(rng.choices(SNIPPETS, k=rng.randint(0, 50))) for _ in range(3000)]
    texts += [None, "", "a  <|endoftext|>  b<|endoftext|><|endoftext|>", " <|endoftext|>", "<|endof", "text|>"]
    counter = token_counts.TokenCounter(PATH, pa.array([b" a", b"a"], pa.large_binary()), np.array([1, 1]))
    assert counter.count(pa.array(texts)).tolist() == library(texts)
    assert counter.count(pa.array(texts).slice(7, 50)).tolist() == library(texts[7:57])


def test_long_texts_in_parts(library, monkeypatch):
    monkeypatch.setattr(token_counts, "AT_ONCE", 1500)
    texts = ["word another  thing x, don't " * 2000, "x", "y z " * 900, "z" * 9000, brute.LONG[:60_000], None]
    assert token_counts.TokenCounter(PATH, *NONE).count(pa.array(texts)).tolist() == library(texts)


def test_a_full_cache_changes_no_count(library):
    texts = [f"w{i} x{i % 13} the" for i in range(300)]
    counter = token_counts.TokenCounter(PATH, *NONE, cached=20)
    assert counter.count(pa.array(texts)).tolist() == library(texts) and len(counter.cache) <= 1000
    for t in texts:
        counter.count(pa.array([t]))
    assert len(counter.cache) <= 23


@pytest.mark.parametrize("sample", [{}, {"rows": 2}, {"most": 0}])
def test_tiers_change_no_count(spark, library, sample):
    df = brute.frame(spark)
    got = token_counts.count_tokens(df, ["doc_id", "n_words", "lang"], **sample).collect()
    rows = brute.rows()
    want = sorted((str(r[0]), r[5], len((r[1] or "").encode()), n) for r, n in zip(rows, library([r[1] for r in rows]), strict=True))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_bytes"], r["n_tokens"]) for r in got) == [(a, b or None, c, d) for a, b, c, d in want]


def test_query_and_empty_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in token_counts.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d, n in zip(docs, library([d["text"] for d in docs]), strict=True):
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], len((d["text"] or "").encode()), n, n > 512)
    assert token_counts.count_tokens(brute.empty(spark)).collect() == []


def test_frequent_pieces(spark):
    df = spark.createDataFrame([("the cat the cat the",)] * 50, "text string")
    pieces, lengths = token_counts.frequent_pieces(df, PATH, most=3)
    assert pieces.to_pylist() == [b" cat", b" the", b"the"] and lengths.tolist() == [1, 1, 1]


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.TokenCounter(tokenizer_path("word_bpe_49k.json"), *NONE)

"""Ids of texts against the tokenizers library on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomdoc.llm import packing, token_files, tokens
from loomdoc.llm.packing import tokenizer_path

#: Parts that texts are made of: letters of several scripts, marks, digits, all sorts of white space, contractions, special tokens.
PARTS = [
    "a", "B", "é", "É", "×", "÷", "ß", "'", "'s", "'re", "'LL", "’", "-", ",", "...", "1", "23", "٣", "中", "日本",
    "\U0001f642", "á", "́", "İ", "ſ", "Σ", "ς", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\0", "_", "·", "ﬁ",
    "Å", "²", "ª", " ", " ", " ", "  ", "\n", "\r\n", "\t", " ", " ", "　", "\x85", " ", "\x1c", "\x1f",
]


def encoded(coder, texts):
    parts = list(coder.encode(pa.array(texts, pa.string())))
    ids, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@pytest.mark.parametrize(("name", "keeps_spaces"), [(token_files.TOKENIZER, True), (packing.TOKENIZER, False)])
@pytest.mark.parametrize(("at_once", "pieces"), [(8 << 20, 600_000), (60, 200)])
def test_ids(monkeypatch, name, keeps_spaces, at_once, pieces):
    """On texts of all parts; with parts of texts and a cache that are far too small, too."""
    monkeypatch.setattr(tokens, "AT_ONCE", at_once)
    monkeypatch.setattr(tokens, "CACHE_PIECES", pieces)
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(6_000)]
    texts += [None, "", " ", "\n", " ".join(["The word-list, it's"] * 300), "x" * 500, "the end " * 200 + "　"]
    library = Tokenizer.from_file(tokenizer_path(name))
    want = [[*e.ids, 0] for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    coder = tokens.Encoder(tokenizer_path(name), 0, keeps_spaces)
    for _ in range(2):  # learnt, then known
        got = encoded(coder, texts)
        assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_no_texts():
    coder = tokens.Encoder(tokenizer_path(packing.TOKENIZER), 2, False)
    assert list(coder.encode(pa.array([], pa.string()))) == []
    assert encoded(coder, [None]) == [[2]]

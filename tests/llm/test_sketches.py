"""What sketches drop: measured on pairs at the least similarity, and classes with and without them."""

import math

import numpy as np

from loomdoc.llm import similar
from tests.llm import brute


def test_no_pair_at_the_threshold_is_dropped():
    """2,000 pairs of sets at 0.8 or just above: distances of sketches stay well below the bound."""
    rng = np.random.default_rng(23)
    p = (1 - similar.SIMILARITY) / 2
    bound = similar.SKETCH * p + similar.DEVIATIONS * math.sqrt(similar.SKETCH * p * (1 - p))
    apart = []
    for k in range(2000):
        common, each = 40 + 8 * (k % 50), 5 + k % 50
        all_ = np.unique(rng.integers(0, 1 << 64, common + 2 * each, np.uint64))
        a, b = np.sort(all_[: common + each]), np.sort(np.delete(all_, np.s_[common : common + each]))
        if common >= similar.SIMILARITY * (common + 2 * each):
            x = np.bitwise_xor(similar.sketch(a), similar.sketch(b)).view(np.uint8)
            apart.append(int(np.unpackbits(x).sum()))
    assert len(apart) > 500 and max(apart) < bound - 8, (len(apart), max(apart), bound)


def test_classes_are_the_same_without_sketches(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        words = rng.choice([f"w{i}" for i in range(900)], 150).tolist()
        texts.append(" ".join(words))
        for edits in (1, 3, 6):
            other = list(words)
            for i in rng.choice(150, edits, replace=False):
                other[i] = "new"
            texts.append(" ".join(other))
    df = brute.frame(spark, texts)
    of = lambda found: {(r["doc_id"], r["component_id"]) for r in found.collect()}
    assert of(similar.classes(df)) == of(similar.classes(df, deviations=None))

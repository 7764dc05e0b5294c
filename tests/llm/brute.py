"""Plain versions of the operators' contracts, and a table of edge cases."""

from __future__ import annotations

import re

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: doc_id, text and columns that clash with the operators' own.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string, component_id string, fp string, row string"
LONG = " ".join(f"word{i % 977} the" for i in range(30_000))
TEXTS = [
    None, "", " \n\t ", "a", "The quick brown fox", "the QUICK brown\nfox", "x " * 50, LONG, LONG + " end", "*** ### |||", "a\n\na\na\nb",
    "\u00e9t\u00e9 \u0130stanbul \u00df \u2028 x", "card 4111111111111111 at 10.1.2.3", "The quick brown fox",
]


def rows(texts=TEXTS):
    """Rows with texts; a repeated row and one without an id at the end."""
    out = [(i, t, "en", "s", len(t or ""), "w", "s", "c", "f", "r") for i, t in enumerate(texts)]
    return [*out, out[4], (None, "no id", None, None, None, None, None, None, None, None)]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(rows(texts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text, n=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def windows(text, n=10):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1) if words else 0)]


def repeated(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen: dict = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)})

"""Tries against a plain version: members of every prefix, figures by looking through all nodes."""

import hashlib
import zlib

import pandas as pd
import pytest

from loomdoc.llm import prefix_trie
from loomdoc.llm.prefix_trie import WIDTH, own_paths, rebuilt_paths, shared_length, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, path string, family string"


def plain(sequences):
    """sequences: {conv_id: [(role, text), ...]}"""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out, inner = set(), {x[:-1] for x in members if x}
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if x not in inner]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns_of(rows):
    """Sorted (role, text) lists by conversation."""
    found = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            found.setdefault(conv, []).append((turn is not None, turn or 0, role, mark, text))
    return {c: [(role, text) for _, _, role, _, text in sorted(t)] for c, t in found.items()}


def rebuilt(sequences):
    out = {}
    for c, own in sequences.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = sequences.get(c - c % 100, [])[:h] + own[h:]
    return out


def got(df):
    rows = df.select(*(c.split()[0] for c in prefix_trie.NODES.split(", "))).collect()
    found = {tuple(r) for r in rows}
    assert len(found) == len(rows)
    return found


def conversation(conv, *texts, first=0):
    return [(conv, first + i, "user" if i % 2 == 0 else "assistant", t, "d", "p", "f") for i, t in enumerate(texts)]


ROWS = [
    *conversation(0, "hi", "hello", "how", "fine", "bye", "bye"),
    *conversation(1, "hi", "hello"),
    *(r for c in range(2, 40) for r in conversation(c, "hi", "hello", "how", "fine", *"abcd"[: c % 5])),
    *(r for c in range(100, 160) for r in conversation(c, "hi", *(["same"] * 9), f"own {c % 7}")),
    *conversation(250, "éß中", "x" * 5000),
    *conversation(251),
    (260, None, None, None, "", "", ""),
    (260, 0, "user", "zero", "", "", ""),
    (260, 0, "user", "tie", "", "", ""),
    (260, 0, "user", "tie", "", "", ""),
    (None, 0, "user", "no conversation", "", "", ""),
    *conversation(270, *("t%d" % i for i in range(120))),
    *conversation(271, *("t%d" % i for i in range(120)), "more"),
    *conversation(70_000_000_000_001, "hi", "hello", "how", "fine"),
]


@pytest.mark.parametrize("most", [30, 300])
def test_against_plain_version(spark, monkeypatch, most):
    """Small limits deal subtries out again and again; copies, caterpillars and long chains included."""
    monkeypatch.setattr(prefix_trie, "LEAST_TURNS", most)
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert got(trie(own_paths(df), most)) == plain(turns_of(ROWS))


def test_rebuilt_conversations(spark):
    sequences = turns_of(ROWS)
    assert got(trie(rebuilt_paths(spark.createDataFrame(ROWS, SCHEMA)))) == plain(rebuilt(sequences))
    assert any(not t for t in rebuilt(sequences).values()), "no turnless conversation is tested"


def test_ids_of_one_path_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    rows = [r for c in range(500) for r in conversation(c, "a", "b")]
    root, one, two = sorted(got(trie(own_paths(spark.createDataFrame(rows, SCHEMA)))), key=lambda r: r[1])
    assert root[:7] == (0, 0, None, 500, 1, 1, 998) and one[:7] == (0, 1, 0, 500, 1, 1, 998) and two[6] == 499
    assert two[7] == hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie(own_paths(df)).count() == 0 and trie(rebuilt_paths(df)).count() == 0


def test_negative_ids(spark):
    rows = [*conversation(-5, "a", "b"), *conversation(-100, "a", "c"), *conversation(-101, "a", "c", "d")]
    want = plain({c: t for c, t in turns_of(rows).items()})
    assert got(trie(own_paths(spark.createDataFrame(rows, SCHEMA)))) == want


def test_shared_length():
    a, b, c = (bytes([x]) * WIDTH for x in (1, 2, 3))
    assert [shared_length(*p) for p in ((a + b, a + b + c), (a, b), (b"", a), (a + b, a + c), (a, a))] == [1 + 1, 0, 0, 1, 1]


def test_growing_is_not_recursive():
    path = b"".join(i.to_bytes(16, "big") + (1).to_bytes(4, "big") for i in range(5000))
    rows = pd.DataFrame({"chain": [b"r"], "up": [7], "depth": [1], "path": [path], "n": [3], "least": [7], "ends": ["e"]})
    nodes = prefix_trie.grow(rows)
    assert len(nodes) == 5000 and nodes["saved_tokens"][0] == 10_000 and nodes["ends_sha256"].iloc[-1] == "e" and set(nodes["n_leaves"]) == {1}

"""The pipeline on planted documents: each stage's decision is seen in the next one's rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomdoc.llm import similar, simhash

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    plain = lambda n: " ".join(rng.choice(words, n).tolist())
    texts = {i: plain(120) for i in range(200)}
    labels = [(i, 1, int(i % 5 == 0)) for i in range(200)]
    for i in range(0, 200, 5):
        texts[i] += " you idiot, you moron, scum " + plain(5)
    texts[300] = texts[1]  # an exact copy
    near = texts[2].split()
    near[60] = "changed"
    texts[301] = " ".join(near)
    texts[302] = plain(30) + " " + ITEM + " " + plain(30)
    texts[303] = "mail jo.doe@mail.example.com card 4111111111111111 " + plain(40)
    texts[304] = "you idiot and moron and scum " + plain(50)
    texts[305] = None
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages(spark, folder, tmp_path):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {i for i in range(0, 200, 5)} | {304}
    assert set(seen["toxicity"]) == set(texts) - toxic
    assert set(seen["simhash"]) == set(seen["toxicity"]) - {300, 301}
    clean = seen["decontamination"]
    assert set(clean) == set(seen["simhash"]) and ITEM not in clean[302] and len(clean[302].split()) == 60
    assert all(clean[i] == texts[i] for i in clean if i != 302)
    private = seen["pii"]
    assert "jo.doe@" not in private[303] and "4111111111111111" not in private[303] and "@mail.example.com" in private[303]
    assert all(private[i] == clean[i] for i in clean if i != 303)
    assert {r["doc_id"] for r in docs.collect()} == set(private)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    assert {r["doc_id"] for r in rows}.isdisjoint({0, 5, 300, 301, 304}) and max(r["offset"] + r["length"] for r in rows) <= 4096


def test_near_copies_by_fingerprint(spark):
    """What SimHash links goes though its shingles are not alike; a class goes on over links of both kinds."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    plain = lambda n: " ".join(rng.choice(words, n).tolist())
    line = plain(41)  # an odd number, so that no bit is even
    texts = [plain(80), " ".join([line] * 300 + [plain(60)]), " ".join([line] * 300 + [plain(60)])]
    changed = texts[2].split()
    changed[-30] = "changed"
    rows = [(i, t) for i, t in enumerate([*texts, " ".join(changed), None, None])] + [(1, "another text of one id"), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fps = [simhash.fingerprint(t) for t in texts]
    assert (fps[1] ^ fps[2]).bit_count() <= 2
    alone = {(r["doc_id"], r["text"]) for r in similar.without_duplicates(docs).collect()}
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert (2, texts[2]) in alone
    assert kept == {rows[0], rows[1], rows[4], rows[6], rows[7]}


def copies(n=160, seed=5):
    """Copies of one text with so many changes that many are near to it or to each other, and many to none."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(n):
        words = list(base)
        for at in rng.choice(120, rng.integers(1, 9), replace=False):
            words[at] = f"c{i}x{at}"
        texts.append(" ".join(words))
    return texts


def least_reachable(texts):
    """The classes by all pairs of shingle sets, in plain Python."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    least = list(range(len(texts)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                least[b] = a
    return [top(i) for i in range(len(texts))]


def test_crowds_of_near_copies(spark, monkeypatch):
    """Members of a crowded key are compared in blocks: all links are found, and no pairs of them are rows."""
    texts = copies()
    want = dict(enumerate(least_reachable(texts)))
    assert 20 < len(set(want.values())) < len(texts) - 20
    pairs, across = [], similar._across
    monkeypatch.setattr(similar, "_across", lambda *args: pairs.append(across(*args)) or pairs[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = similar.classes(docs, crowd=8).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert pairs[0].count() < len(texts)


def test_blocks_of_crowds(spark):
    """Two blocks of a crowd find what all its members have; links are no more than connect them."""
    texts = copies(60, 6)
    sets = [similar.shingle_set(t, 5) for t in texts]
    known = [(i, len(s), *similar.sketch(s).tolist()) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(known, "node bigint, n int, " + ", ".join(f"{s} bigint" for s in similar.LONGS))
    members = spark.createDataFrame([(0, i, i) for i in range(60)], "crowd bigint, node bigint, component bigint")
    shingles = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "node bigint, shingles array<bigint>")
    want = {i: c for i, c in enumerate(least_reachable(texts)) if c != i}
    for block in (7, 1024):
        links = similar.crowd_links(similar.dealt_crowds(members, nodes, 0.8, similar.DEVIATIONS, block), shingles, 0.8)
        assert {r["node"]: r["component"] for r in similar.components(links).collect()} == want
    assert links.count() == len(want)


def test_crowds_of_passages(spark):
    """Keys that have a text in common are not one crowd for that; the members of a key are, and a pair of far sizes is no task's."""
    keys = [(t, 39 * t + i, 39 * t + i, 40 if i % 2 else 4000) for t in range(30) for i in range(40)]  # each key has a member of the next one
    open_ = spark.createDataFrame(keys, "token bigint, node bigint, component bigint, n int")
    members = similar.crowds(open_.drop("n"))
    crowds = {}
    for r in members.collect():
        crowds.setdefault(r["crowd"], set()).add(r["node"])
    assert max(map(len, crowds.values())) <= 3 * 40 and sum(map(len, crowds.values())) <= len(keys)
    assert all(any(set(range(39 * t, 39 * t + 40)) <= c for c in crowds.values()) for t in range(30))
    nodes = open_.select("node", "n", *[F.lit(0).cast("long").alias(s) for s in similar.LONGS]).dropDuplicates(["node"])
    together = similar.dealt_crowds(members, nodes, 0.8, similar.DEVIATIONS, 16).join(nodes, "node").groupBy("crowd", "part", "i", "j")
    assert all(r["least"] == r["most"] for r in together.agg(F.min("n").alias("least"), F.max("n").alias("most")).collect())


def test_parts_of_a_crowd_leave_no_pair_out(spark):
    """Partners of all sizes meet in a part, those at the bound of the similarity as well."""
    sizes = [(m, -(-4 * m // 5)) for m in range(1, 400)]
    rows = [(2 * k + side, k, n) for k, pair in enumerate(sizes) for side, n in enumerate(pair)]
    df = spark.createDataFrame(rows, "node bigint, crowd bigint, n int")
    nodes = df.select("node", "n", *[F.lit(0).cast("long").alias(s) for s in similar.LONGS])
    members = df.select("crowd", "node", F.col("node").alias("component"))
    met = similar.dealt_crowds(members, nodes, 0.8, similar.DEVIATIONS, 1).groupBy("crowd", "part").count().filter("count = 2")
    assert {r["crowd"] for r in met.collect()} == set(range(len(sizes)))

"""Ids of 64 bits beside rows without one, and rows that share an id, in every operator that carries them."""

import pytest

import corpus_pipeline
from loomdoc.llm import decontaminate, packing, pii, quality, simhash, similar, token_files, toxicity
from loomdoc.llm.packing import tokenizer_path
from tests.llm import brute

A, B, C = (1 << 62) + 12_345, (1 << 62) + 12_346, -(1 << 63)
TEXTS = {A: "one two three four five six", B: "seven eight nine ten eleven twelve", C: "some other words that stand here", None: "a text without an id"}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in TEXTS.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


WANT = sorted(TEXTS, key=str)


def test_operators(spark, rows):
    bench = spark.createDataFrame([(B, "one two three")], "item_id bigint, text string")
    assert ids(simhash.near_duplicates(rows)) == WANT
    assert ids(decontaminate.judge(rows, bench)) == WANT and ids(decontaminate.without_hits(rows, bench)) == WANT
    assert ids(quality.judge(rows, None)) == WANT
    assert ids(packing.pack_documents(rows)) == WANT
    assert ids(pii.pseudonymise(rows)) == WANT
    assert ids(toxicity.score(rows, toxicity.Lexicon())) == WANT
    assert ids(similar.classes(rows)) == sorted([A, B, C], key=str) and ids(similar.without_duplicates(rows)) == WANT


def test_components_keep_ids_apart(rows):
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows).collect()}
    assert all(found[i] == i for i in (A, B, C))


@pytest.mark.parametrize("shard_ids", [4, 1 << 30])
def test_token_files(spark, tmp_path, rows, shard_ids):
    """Without an id first, then the least; rows of one id and rows of none over several shards."""
    more = spark.createDataFrame([(A, f"again {i}") for i in range(5)] + [(None, f"none {i}") for i in range(5)], "doc_id bigint, text string")
    every = rows.select("doc_id", "text").unionByName(more)
    token_files.write_files(every, str(tmp_path / "f"), tokenizer_path(token_files.TOKENIZER), 0, token_files.VOCABULARY, shard_ids=shard_ids, block_ids=8)
    got = token_files.read_files(spark, str(tmp_path / "f"), token_files.VOCABULARY).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 6 + [C] + [A] * 6 + [B]
    assert [r["start"] for r in got] == [sum(r["n_ids"] for r in got[:k]) for k in range(len(got))]
    n_shards = spark.read.parquet(str(tmp_path / "f" / "blocks")).select("shard").distinct().count()
    assert n_shards == 1 if shard_ids > 100 else n_shards > 3


def test_pipeline_stages(spark, rows, tmp_path):
    """Each stage after the first keeps all rows; a shared id is two documents if the texts differ."""
    shared = spark.createDataFrame([(A, "a wholly different text of some words", "en", "s", 37)], rows.schema)
    docs = rows.unionByName(shared).unionByName(shared)
    sf = str(tmp_path)
    spark.createDataFrame([(1, "no such item")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["simhash"](spark, docs, sf)
    want = sorted([*TEXTS, A], key=str)
    assert ids(kept) == want
    assert ids(stages["decontamination"](spark, kept, sf)) == want and ids(stages["pii"](spark, kept, sf)) == want


def test_empty_stages(spark, tmp_path):
    """Every stage takes an empty table."""
    sf, docs = str(tmp_path), brute.empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0, name

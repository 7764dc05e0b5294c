"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, pseudonyms, packing.

The near-duplicate stage links texts by SimHash (``loomdoc.llm.simhash``: at two of 64 bits), and as that is far closer than a
similarity of 0.8, the exact join of sets of five-word shingles (``loomdoc.llm.similar``) goes on from its classes.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
reread as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import decontaminate, packing, pii, similar, simhash, toxicity
from loomdoc.llm.shared import drop_since, mark, scratch_path
from loomdoc.tables import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. The lexicon is learnt from labelled rows of ``docs``.

    Null and empty texts have no evidence and stay; texts of any length are read whole; equal texts score alike, so repeated
    rows stay or go together; without labels, or with those of one class only, all stay; columns pass as they are.
    """
    return toxicity.without_toxic(docs, toxicity.learn(docs, load(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id. Fingerprints of two bits' distance link texts, as
    in ``op3_simhash``, and so do five-word shingles at a similarity of 0.8; a class is what links of both kinds reach.

    Texts without words (null, empty, white space) are one class; a text of fewer words than a shingle is one shingle;
    repeated rows are one document, rows that share a doc_id with different texts are several, rows without a doc_id stay;
    an empty table gives an empty one; columns pass as they are, but for names that begin with ``__judged``.
    """
    return similar.without_duplicates(docs, known=simhash.text_classes(docs))


def with_lengths(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as its texts now are (null for a null text); without such a column, ``docs`` as it is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that the benchmark has.

    A null text stays null; a text that is a passage and nothing else becomes empty and stays; passages that overlap go as
    one; an item of fewer words than a window is one window; an empty benchmark or table changes nothing; all other columns
    but n_chars pass as they are.
    """
    return with_lengths(decontaminate.without_hits(docs, load(spark, sf_dir, "benchmark")))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data, under the session's key.

    A null text stays null, texts without data are untouched, equal values get equal pseudonyms in all rows; an empty table
    gives an empty one; all other columns but n_chars pass as they are.
    """
    return with_lengths(pii.pseudonymise(docs, counts=None))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    Null and empty texts are the end id alone; a long text is as many pieces as it needs; repeated rows are packed each;
    an empty table has no pieces; other columns are not carried.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", pseudonyms),
    ("packing", pack),
]

#: Learnt scores, fingerprints, indexes and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_since(spark, before, {path})  # the stage before, and what this one kept for itself
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

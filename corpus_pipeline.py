"""Corpus preparation: language ID, near-dedup, passage dedup, decontamination and mixing, one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the
columns of documents; the last adds the copy's number and its place in the shuffle.

In every stage an empty table gives an empty result, and columns that documents don't have
stay and never clash with a stage's own; very long texts are processed whole. Repeated rows
(equal doc_id and text) are treated alike: both stay or both go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontam, langid, minhash, mixing, suffix_dedup
from siftline.llm.shared import drop, stage, table

LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that no language explains to LEAST_SCORE.

    Null and empty texts go. Rows with null lang are judged, but not learned from; without any row to learn from all go.
    """
    filters = langid.learn(docs.select("doc_id", "text", "lang").filter(~langid.held_out(F.col("doc_id"))))
    return langid.keep_identified(docs, filters, LEAST_SCORE)


def without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """docs without the dropped ids. The ids are written first, so that Spark knows their size when it picks the join."""
    return docs.join(stage(dropped.select("doc_id").distinct(), name), "doc_id", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: the smallest doc_id of each group stays.

    Null and empty texts are like nothing, so they stay. Of equal texts the smallest doc_id stays.
    """
    return without(docs, minhash.near_duplicates(docs, k=5, percent=80).filter(~F.col("kept")), "near-duplicates")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 50 bytes or more that a document with a smaller doc_id has too.

    Null and shorter texts stay as they are. Of equal texts the smallest doc_id keeps its own; rows of which only white space is left go.
    """
    return suffix_dedup.cut_texts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or a paraphrase of one.

    Null and empty texts hold none; an empty benchmark drops nothing.
    """
    leaks = decontam.find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, leaks.filter("contaminated"), "leaks")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies to equal mass per source, in global random order.

    A null source is one of its own; a source whose texts are all null or empty has no mass and no copies. Columns named n_copies, copy_no and shuffle_key are replaced.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("passage_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

ORACLE_SQL = None  # language ID, retrieval and passage dedup aren't SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Written tables and what is left on disk."""

import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline import session
from siftline.llm import suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture
def own_tables(spark, monkeypatch):
    """The written tables of a test alone."""
    found: list[str] = []
    monkeypatch.setattr(session, "_WRITTEN", found)
    return found


def shuffle_files(spark) -> set[str]:
    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in root for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def test_written_leaves_no_shuffle_files(spark):
    before, kept = shuffle_files(spark), spark.conf.get(session.CLEANUP, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k")
    table = session.written(rows, "counts")
    assert shuffle_files(spark) == before and table.count() == 7
    assert spark.conf.get(session.CLEANUP, None) == kept


def test_drop_removes_one_table(spark, own_tables):
    a, b = (session.written(spark.range(n), "rows") for n in (2, 3))
    paths = [urlparse(p).path for p in own_tables]
    session.drop(a, spark.range(1))
    assert [os.path.exists(p) for p in paths] == [False, True] and len(own_tables) == 1 and b.count() == 3


def test_repeats_keep_only_what_the_result_reads(spark, own_tables):
    docs = spark.createDataFrame([(1, "a" * 30 + "b" * 40), (2, "c" + "a" * 30 + "b" * 40), (3, "d" * 60)], "doc_id long, text string")
    rows = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digests(suffix_dedup.remove_repeats(docs)).collect()}
    assert rows == {1: 0, 2: 70, 3: 0}
    assert sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in own_tables) == ["copies", "firsts", "ids", "marks"]


def test_pipeline_drops_a_stage_when_the_next_is_written(spark, own_tables):
    corpus_pipeline.run(spark, SF).count()
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in own_tables}
    assert "decontamination" in left and not left & {"language_id", "near_dedup", "passage_dedup"}

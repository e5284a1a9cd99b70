from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import matching as M
from siftline.functions import text, urls


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(column(F.col("x"))).collect()]


def test_titles_and_cut(spark):
    assert values(spark, ["Flood closes the northern bridge - Daily Example", "Short - tail"], lambda c: text.clean_title(c)) == ["Flood closes the northern bridge", "Short - tail"]
    assert values(spark, ["abc", "one two three four"], lambda c: text.cut(c, 14)) == ["abc", "one two three…"]
    assert values(spark, ["Ä b-c"], lambda c: text.sim_norm(c)) == ["ä b c"]
    assert values(spark, ["The ABC Äx  y"], lambda c: text.norm_match(c)) == ["the abc Äx y"]
    assert values(spark, ["é", "😀"], text.utf16_length) == [1, 2]
    assert values(spark, ["stories", "walking", "bus", "ét"], text.stem_en)[:3] == ["story", "walk", "bus"]


def test_batches_are_sliced_and_only_numbers_leave(spark):
    import pyarrow as pa

    texts = ["x" * 30, None, "é" * 20, "", "y" * 100, "z"]
    got = list(text.text_slices(pa.array(texts), 50))
    assert [t for some in got for t in some] == texts and [len(some) for some in got] == [2, 2, 1, 1]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [tuple(r) for r in df.select(text.gram_counts(F.col("t")), F.size(text.gram_hashes(F.col("t")))).collect()] == [(1, 1), (0, 0), (1, 1), (0, 0), (1, 1), (0, 0)]


def test_grams_and_jaccard(spark):
    df = spark.createDataFrame([("abcde", "abcdx"), ("abc", "abc"), (None, "abcd")], "a string, b string")
    got = df.select(F.size(text.grams(F.col("a"))), text.jaccard(text.grams(F.col("a")), text.grams(F.col("b")))).collect()
    assert [tuple(r) for r in got] == [(2, pytest.approx(1 / 3)), (0, 0.0), (0, 0.0)]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www.m.Example.com/News/Item/?b=2&utm_source=x&a=1#top", "example.com/news/item?a=1&b=2"),
        ("https://amp.example.com/a/amp/", "example.com/a"),
        ("https://youtu.be/abcdefghijk?t=3", "youtube.com/watch?v=abcdefghijk"),
        ("https://www.youtube.com/shorts/abcdefghijk", "youtube.com/watch?v=abcdefghijk"),
        ("", None),
        (None, None),
    ],
)
def test_canonical_key(spark, url, key):
    assert values(spark, [url], urls.canonical_key) == [key]


def test_host_rules_end_at_dots(spark):
    df = spark.createDataFrame([("newsx.com",), ("a.x.com",), ("x.com",)], "host string")
    got = urls.on_hosts(df, "host", spark.createDataFrame([("x.com",)], "host string"))
    assert {r["host"]: r["listed"] for r in got.collect()} == {"newsx.com": False, "a.x.com": True, "x.com": True}


V = M.Vocabulary.of([
    {"tier": "constituency", "term": "oldport", "group": "port"}, {"tier": "area", "term": "port"}, {"tier": "crime", "term": "theft", "role": "urgent", "group": "theft"},
    {"tier": "civic", "term": "flood*", "role": "urgent", "group": "water"}, {"tier": "exclude", "term": "oldport wine", "role": "exclude"}, {"tier": "veto", "term": "advert"}, {"tier": "area", "term": "நகர்"},
])


def test_spans_masks_and_buried():
    assert M.Term("flood*", "civic", 2).spans("floods, flooding; aflood") == [(0, 6), (8, 16)]
    assert "oldport" not in V.masked("a glass of oldport wine")
    buried = M.Vocabulary.of([{"tier": "area", "term": "நகர"}, {"tier": "area", "term": "நகரம"}])
    assert [h.term.text for h in buried.hits("நகரம")["area"]] == ["நகரம"]


def test_score_and_urgency():
    assert M.score_item(V, "Floods in Oldport", None, "x")["band"] == "AI"
    assert M.score_item(V, "Floods in Oldport", None, "advert")["band"] == "DROP"
    assert M.score_item(V, None, None, None) == {"score": 0, "band": "DROP", "terms": [], "tags": [], "veto": None}
    assert M.urgent_item(V, "Theft in Oldport", None, "")["zone"] == "title"
    assert M.urgent_item(V, "News", None, "oldport " + "x" * 450 + " theft") is None
    assert M.urgent_item(V, "News", None, "y" * 450 + " oldport had a theft")["zone"] == "body"


def test_bad_row_is_isolated(spark, monkeypatch):
    got = M.score_items(spark.createDataFrame([("Floods in Oldport",)], "title string"), V).select("scored.band").first()[0]
    assert got == "AI"


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=80))
def test_matched_is_idempotent(s):
    assert M.matched(M.matched(s)) == M.matched(s)
    assert not re.search(r"\s\s", M.matched(s))


def test_grams_of_a_long_title_in_one_pass(spark):
    df = spark.createDataFrame([("é😀" * 50_000,), ("😀😀😀😀",), ("",)], "t string").select(text.grams(F.col("t")).alias("g"))
    assert [r["g"] for r in df.collect()] == [["é😀é😀", "😀é😀é"], ["😀😀😀😀"], []]
    assert "substring(" not in df._jdf.queryExecution().executedPlan().toString().lower()

"""The automaton and the position map against the terms' own patterns."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftline.functions import matching as M
from siftline.functions import text as T
from siftline.functions.automaton import Matcher, term_spans
from siftline.functions.positions import norm_map

rng = random.Random(1)
TEXTS = [
    "இருவர் பலி கொலைகள் திருவான்மியூரில்", "a.b a a a ab aba ababa", "  He‍llo​  Ẃorld\n\tx ", "Été à la plage", "가 x", " ", " \n", "", "aé", "u.s. xu.s. U.S.", "trash trasy atras trash", "ொ ﻿",
    *("".join(rng.choice("ab \n.éÉéA1​") for _ in range(rng.randrange(0, 1500))) for _ in range(120)),
]
TERMS = [M.Term(x, "area", 1) for x in ["பலி", "கொலை", "திருவான்மியூர்", "a", "ab", "aba", "b a", "a b a", "é", "tras*", "u.s.", "éa", "e", "", "*", "1", "a*"]]


def test_map_points_into_the_source():
    for t in TEXTS:
        m = norm_map(t)
        assert m.text == M.matched(t) and len(m.start) == len(m.stop) == len(m.text)
        for a in range(0, len(m.text), 5):
            b = min(len(m.text), a + 4)
            lo, hi = m.source(a, b)
            whole = lambda x: unicodedata.normalize("NFC", M.matched(x))
            assert whole(m.text[a:b]) in whole(t[lo:hi]) and 0 <= lo <= hi <= len(t)
    assert norm_map(None).text == "" and norm_map("x  y").source(1, 1) == (1, 1)
    assert norm_map("He​llo  Éte").source(6, 9) == (8, 12)


def test_automaton_like_each_pattern():
    matcher = Matcher(TERMS)
    norm = [M.matched(t) for t in TEXTS]
    for t, got in zip(norm, matcher.spans(norm), strict=True):
        assert got == sorted((k, *s) for k, x in enumerate(matcher.terms) for s in x.spans(t))
    assert Matcher([]).spans(["a b", ""]) == [[], []] and matcher.spans([]) == []


def test_automaton_over_pieces(monkeypatch):
    from siftline.functions import automaton

    monkeypatch.setattr(automaton, "PIECE", 16)
    monkeypatch.setattr(automaton, "LANES", 3)
    test_automaton_like_each_pattern()


def test_spans_in_the_source(spark):
    rows = spark.createDataFrame([(1, "Ou  e\u0301Te\u0301\n ab"), (2, None), (3, "ab AB")], "id long, t string")
    terms = [M.Term("été", "area", 1), M.Term("ab", "area", 1)]
    got = {r["id"]: [tuple(h) for h in r["h"]] for r in rows.select("id", term_spans(spark, terms, F.col("t"), in_source=True).alias("h")).collect()}
    assert got == {1: [(0, 4, 9), (1, 11, 13)], 2: [], 3: [(1, 0, 2), (1, 3, 5)]}


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_normal_forms_compose(spark, form):
    rows = [(unicodedata.normalize(form, t),) for t in ("Été à la plage", "கொலை", "ொ")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.norm_match(F.col("t"))).collect()]
    assert got == [M.matched(t) for (t,) in rows] and all(unicodedata.is_normalized("NFC", x) for x in got)

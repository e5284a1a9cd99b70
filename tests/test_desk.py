"""Packing of blocks, guards, overlaps, versions and explanations on small rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import overlap, ranking, rendering
from siftline.operators.explain import Step, explained
from siftline.sources import versions


def test_blocks_stay_whole(spark):
    sizes = {("e", 0, "A"): [50, 50], ("e", 1, "B"): [99], ("e", 2, "C"): [120, 120, 120], ("e", 3, "D"): [5], ("f", 0, "A"): [400]}
    rows = [(e, s, k, h, "x" * n) for (e, s, h), own in sizes.items() for k, n in enumerate(own)]
    out = {(r["edition"], r["message"]): r["text"] for r in rendering.packed(spark.createDataFrame(rows, "edition string, section_order int, line_order int, section string, line string").repartition(3), limit=200).collect()}
    x = "x".__mul__
    assert out["e", 1] == f"A\n{x(50)}\n{x(50)}" and out["e", 2].startswith(f"B\n{x(99)}\n\nC")
    assert out["e", 3] == f"C (continued)\n{x(120)}" and out["e", 5] == f"C (continued)\n{x(120)}\n\nD\n{x(5)}"
    assert out["f", 1] == "A" and out["f", 2] == f"A (continued)\n{x(400)}"


def test_generic_names_need_an_anchor(spark):
    p = ranking.Profile(names=["mira vale"], generic=["minister vale"], anchors=["oldport"], district_places=["northshire"])
    rows = [
        (1, "mention", [], "minister vale spoke", None), (2, "mention", [], "minister vale spoke in oldport", None), (3, "mention", ["portfolio"], "minister vale spoke", None),
        (4, "political", ["party"], "northshire council", None), (5, "district", [], "a northshire fair", ["Minister Vale opened it"]), (6, "district", [], "mira vale at a northshire fair", ["Minister Vale opened it"]),
    ]
    df = spark.createDataFrame(rows, "id long, category string, tags array<string>, text_norm string, takeaways array<string>").withColumns({"title_norm": F.col("text_norm"), "reason": F.lit("r")})
    got = {r["id"]: (r["category"], r["guard"], r["reason"], r["takeaways"]) for r in ranking.guard(df, p).collect()}
    assert got[1] == ("none", "not named", "r [guard: not named -> none]", None) and got[2][:2] == ("mention", None) and got[3][:2] == ("mention", None)
    assert got[4][:2] == ("political", None) and got[5] == ("district", "notes", "r", []) and got[6][:2] == ("mention", "named") and got[6][3]


def test_guard_reads_a_text_once_a_pattern(spark):
    p = ranking.Profile(names=["mira vale"], constituency_places=["oldport"], outside_places=["farcity"], district_places=["northshire"], portfolio=["rail"], commercial=["sale"], governance=["council"])
    rows = [(1, "constituency", [], "farcity", "rail sale"), (2, "political", [], "x", "a railway"), (3, "district", None, "x", None), (4, "none", [], "x", "rail sale")]
    df = spark.createDataFrame(rows, "id long, category string, tags array<string>, title_norm string, text_norm string").withColumn("reason", F.lit("r"))
    out = ranking.guard(df, p)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == [*df.columns, "guard"] and plan.count("(?:rail)") == 1 and plan.count("(?:northshire)") == 1
    assert {r["id"]: (r["category"], r["guard"]) for r in out.collect()} == {1: ("none", "commercial"), 2: ("none", "not anchored"), 3: ("district", None), 4: ("none", None)}


def test_a_stage_that_adds_nothing_writes_nothing(spark):
    rows = spark.range(4)
    look = Step("look", None, F.lit("seen"), F.col("id"), F.col("id") > 1)
    trail, left = explained(rows, [look])
    assert sorted(r["id"] for r in left.collect()) == [2, 3] and trail.count() == 4 and "parquet" not in trail._jdf.queryExecution().executedPlan().toString()


def test_overlaps_like_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3000), f"t{rng.randrange(2)}", [f"p{rng.randrange(6)}" for _ in range(rng.randrange(4))], [f"g{rng.randrange(4)}"]) for i in range(200)] + [(900, 10, None, ["p1"], None), (901, 10, "t1", None, ["g1"])]
    df = spark.createDataFrame(rows, "id long, ts long, target string, places array<string>, groups array<string>")
    after = lambda a, b: (a[1], a[0]) < (b[1], b[0])
    want = {(a[0], b[0]) for a in rows for b in rows if after(a, b) and b[1] - a[1] <= 500 and a[2] and a[2] == b[2] and set(a[3] or ()) & set(b[3] or ())}
    assert sorted(map(tuple, overlap.overlap_pairs(df, df, 500).collect())) == sorted(want)
    told = {r["id"]: r for r in overlap.seen_near(df, 500).collect()}
    by = {r[0]: r for r in rows}
    for i, r in told.items():
        own = [a for a, b in want if b == i]
        assert r["near"] == len(own) and r["last"] == (max(own, key=lambda a: (by[a][1], a)) if own else None)
        if by[i][4]:
            assert set(r["fresh"]) == set(by[i][4]) - {g for a in own for g in by[a][4] or ()}


def test_near_rows_are_counted_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(overlap, "overlap_pairs", lambda *a, **k: pytest.fail("pairs were made"))
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("ts"), F.lit("t").alias("target"), F.array(F.lit("p"), F.concat(F.lit("q"), F.col("id") % 2)).alias("places"), F.array(F.lit("g")).alias("groups"))
    got = {r["id"]: r for r in overlap.seen_near(df, 1).collect()}
    assert (got[0]["near"], got[0]["last"], got[0]["fresh"]) == (0, None, ["g"])
    assert (got[2999]["near"], got[2999]["last"], got[2999]["fresh"]) == (1999, 2996, [])  # all of the second before, and its own second's earlier ones


def test_last_good_version(spark):
    states = [(1, 100, None), (2, 90_000, "HTTP 500"), (3, 200_000, None), (4, 200_000, "no rows")]
    df = spark.createDataFrame(states, "version long, fetched_at long, problem string")
    times = spark.createDataFrame([(t,) for t in (5, 100, 101, 90_000, 190_000, 200_000, 999_999, 999_999)], "at long")
    got = sorted((r["at"], r["version"], r["origin"], r["problem"]) for r in versions.last_good(df, times).collect())
    assert got == [(5, 0, "seed", None), (100, 1, "sheet", None), (101, 1, "sheet", None), (90_000, 1, "kept", "HTTP 500"), (190_000, 1, "kept", "HTTP 500"), (200_000, 3, "kept", "no rows"), (999_999, 3, "kept", "no rows"), (999_999, 3, "kept", "no rows")]


def test_trail_ends_where_an_item_goes(spark):
    items = spark.range(6)
    half = Step("half", lambda df: df.withColumn("x", F.col("id") * 2), F.when(F.col("id") < 3, "low").otherwise("high"), F.col("x"), F.col("id") < 3)
    odd = Step("odd", lambda df: df, F.lit("seen"), F.lit(None), F.col("id") % 2 == 1)
    trail, left = explained(items, [half, odd])
    assert sorted((r["id"], r["stage"], r["decision"], r["detail"]) for r in trail.collect()) == sorted([(i, "half", "low" if i < 3 else "high", str(2 * i)) for i in range(6)] + [(i, "odd", "seen", None) for i in range(3)])
    assert [r["id"] for r in left.collect()] == [1]


def test_written_tables_go(spark):
    from siftline.session import drop_written, written

    drop_written(spark)
    df = written(spark.range(5), "gone")
    assert df.count() == 5 and drop_written(spark) == 1 and drop_written(spark) == 0
    assert written(spark.range(3), "again").count() == 3


def test_sinks_write_what_they_say(spark, tmp_path):
    from siftline.sources import sinks

    items = spark.createDataFrame([(1, "2024-01-01", "b", "t1"), (2, "2024-01-02", "b", "t, 2")], "id long, day string, body string, title string")
    sinks.write_archive(items, items.filter("id = 2").select("id"), F.col("day"), str(tmp_path / "archive"))
    back = spark.read.parquet(str(tmp_path / "archive"))
    assert sorted((r["id"], r["shown"]) for r in back.collect()) == [(1, False), (2, True)] and "body" not in back.columns
    sinks.export_csv(items.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfid,") and b'"t, 2"' in text
    assert sinks.publish_if_changed(items, str(tmp_path / "edition")) and not sinks.publish_if_changed(items.orderBy(F.desc("id")), str(tmp_path / "edition"))

from __future__ import annotations

import random
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline import session
from siftline.operators import events as E
from siftline.operators import anchored, graph, merge, ranking, reports, selection, similarity
from siftline.plans import similarity_plans
from siftline.sources import feeds, sheets, sinks
from siftline.streaming import folds


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {100, 7} and got[160] == 100 and got[39] == 7
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    df, made = spark.createDataFrame(edges, "a long, b long"), []
    rounds = {tuple(r) for r in graph.components(df, few_links=0).collect()}
    late = {tuple(r) for r in graph.components(df, few_links=60).collect()}
    own = graph.written
    monkeypatch.setattr(graph, "written", lambda table, name: made.append(name) or own(table, name))
    assert {tuple(r) for r in graph.components(df).collect()} == rounds == late
    assert made == ["edges", "components"]


def test_anchored_merge_never_chains(spark):
    rng = random.Random(3)
    edges = {(a, b) for _ in range(80) for a, b in [sorted(rng.sample(range(40), 2))]}
    ranked = spark.createDataFrame([(i, i) for i in range(40)], "id long, rank long")
    got = {r["id"]: r["representative"] for r in graph.greedy_representatives(ranked, spark.createDataFrame(list(edges), "a long, b long")).collect()}
    want, reps = {}, []
    for i in range(40):
        want[i] = next((r for r in reps if (r, i) in edges), i)
        if want[i] == i:
            reps.append(i)
    assert got == want


def test_similar_pairs_in_blocks(spark):
    rows = [(i, f"h{i % 3}", "the quick brown fox jumps " + "abcdefghij"[: i % 10] + str(i // 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, host string, body string")
    whole = {tuple(r) for r in similarity.similar_pairs(df, threshold=0.7).collect()}
    blocks = {tuple(r) for r in similarity.similar_pairs(df, threshold=0.7, block_rows=13).collect()}

    def grams(s):
        return {s[k : k + 4] for k in range(len(s) - 3)}

    want = {(a, b) for a, ha, ta in rows for b, hb, tb in rows if a < b and ha != hb and len(grams(ta) & grams(tb)) / len(grams(ta) | grams(tb)) >= 0.7}
    assert {(a, b) for a, b, _ in whole} == want == {(a, b) for a, b, _ in blocks}


def test_packed_sets_and_bounds_of_a_unit(monkeypatch):
    """Products bound overlaps from above, sets come back as they were, and pairs are brute force's, with a large group of copies and without."""
    rng = np.random.default_rng(7)
    every = rng.integers(-(2**63), 2**63 - 1, 300)
    sets = [rng.choice(every, rng.integers(3, 60), replace=False) for _ in range(90)]
    sets += [sets[5]] * 40 + [sets[k][2:] for k in range(20)]
    common = np.sort(every[:70])
    for known in (common, common[:0]):
        assert all(set(similarity.unpack(similarity.pack(s, known), known).tolist()) == set(s.tolist()) for s in sets)
    sizes = np.array([len(s) for s in sets])
    both = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    marks = similarity._marks(sets, common, 8)
    assert (marks @ marks.T >= both - 1e-3).all()
    ids, hosts, side = rng.permutation(len(sets)), np.arange(len(sets)) % 3, np.arange(len(sets)) % 2
    sim = both / (sizes[:, None] + sizes[None] - both)
    counted = []
    shared = similarity._shared
    monkeypatch.setattr(similarity, "_shared", lambda *a: counted.append(1) or shared(*a))
    for two in (False, True):
        for cross in (False, True):
            want = {(min(ids[i], ids[j]), max(ids[i], ids[j]), sim[i, j]) for i in range(len(sets)) for j in range(i) if sim[i, j] >= 0.45 and (not two or side[i] != side[j]) and (not cross or hosts[i] != hosts[j])}
            got = [tuple(x) for found in similarity._unit_pairs(ids, hosts, side * two, sets, 0.45, cross) for x in zip(*found, strict=True)]
            assert len(got) == len(want) > 100 and set(got) == want
    assert counted and len(counted) < 4 * len(sets)


def test_pairs_in_waves_are_those_of_one(spark, monkeypatch):
    """What is dealt at once is bounded, whatever the number of pairs of blocks, and nothing but the pairs is left."""
    rows = [(i, f"h{i % 3}", "the quick brown fox jumps " + "abcdefghij"[: i % 10] + str(i // 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, host string, body string")
    whole = {tuple(r) for r in similarity.similar_pairs(df, threshold=0.7, block_rows=13).collect()}
    sweep = sorted(tuple(r) for r in similarity.threshold_sweep(df, [0.4, 0.7], block_rows=13).collect())
    dealt = []
    own = similarity.unit_rows
    monkeypatch.setattr(similarity, "unit_rows", lambda placed, units, each: dealt.append(units.count()) or own(placed, units, each))
    monkeypatch.setattr(similarity, "WAVE_BYTES", 1)
    with session.tables_written() as made:
        waves = similarity.similar_pairs(df, threshold=0.7, block_rows=13)
        assert {tuple(r) for r in waves.collect()} == whole and len(whole) > 100
    assert len(dealt) > 4 and max(dealt[1:]) < sum(dealt[1:])
    assert [t for t in made if t in session._PATH_OF] == [waves]
    assert sorted(tuple(r) for r in similarity.threshold_sweep(df, [0.4, 0.7], block_rows=13).collect()) == sweep


def test_blocks_of_large_sets_have_fewer_rows(spark):
    sets = spark.createDataFrame([(i, "h", 0, 10 if i < 40 else 6000) for i in range(60)], "id long, host string, band long, n int")
    placed, units = similarity.size_blocks(sets, 0.5, 10)
    most = {r["n"]: r["rows"] for r in placed.groupBy("n", "batch").count().groupBy("n").agg(F.max("count").alias("rows")).collect()}
    assert most[10] == 10 and most[6000] == 2 and placed.count() == 60


def test_sweep_reads_whole_bodies(spark, tmp_path):
    """Two texts that part after their first 1,200 characters, and three that agree only from there on."""
    rng = random.Random(2)
    a, b, c, d = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (1200, 6000, 6000, 1200))
    rows = [(0, a + b, "en", "s", 7200), (1, a + c, "en", "t", 7200), (2, d + b, "en", "u", 7200), (3, d[::-1] + b, "en", "u", 7200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in similarity_plans.near_dup_threshold_sweep(spark, str(tmp_path)).collect())
    assert got == [(t, 3, 2, 2) for t in similarity_plans.SWEEP]


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_sweep_counts_without_pairs(spark, monkeypatch, block_rows):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(5)) for _ in range(12)]
    rows = [(i, None if i % 11 == 0 else f"h{i % 3}", i % 2, " ".join(rng.choice(words) for _ in range(rng.randint(4, 14)))) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, host string, band long, body string")
    monkeypatch.setattr(similarity, "set_pairs", lambda *a, **k: pytest.fail("pairs were made"))
    got = sorted(tuple(r) for r in similarity.threshold_sweep(df, [0.25, 0.5, 0.99], block_rows=block_rows).collect())

    def jaccard(s, t):
        a, b = ({x[k : k + 4] for k in range(len(x) - 3)} for x in (s, t))
        return len(a & b) / len(a | b)

    pairs = [(ha, hb, b, jaccard(ta, tb)) for a, ha, la, ta in rows for b, hb, lb, tb in rows if a < b and la == lb]
    want = []
    for t in (0.25, 0.5, 0.99):
        own = [p for p in pairs if p[3] >= t]
        want += [(t, len(own), sum(x is not None and y is not None and x != y for x, y, *_ in own), len({p[2] for p in own}))] if own else []
    assert got == want


@pytest.mark.parametrize("head_rows", [8, 4096])
def test_merge_of_similar_rows_makes_no_pairs(spark, monkeypatch, head_rows):
    """Brute force, one row after the other, over whole texts, with copies in one host and in two, several bands and a text without grams."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(5)) for _ in range(14)]
    lead = "same opening words " * 70
    texts = [lead + " ".join(rng.choice(words) for _ in range(rng.choice([3, 200, 400]))) for _ in range(20)] + [" ".join(rng.choice(words) for _ in range(rng.randint(4, 14))) for _ in range(70)]
    texts += texts[20:45] + ["x"]
    rows = [(i, f"h{rng.randrange(3)}", i % 2, rng.random(), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, host string, band long, rank double, body string")
    for module in (similarity, anchored):
        monkeypatch.setattr(module, "set_pairs", lambda *a, **k: pytest.fail("pairs were made"), raising=False)
    got = {r["id"]: r["representative"] for r in anchored.merge_similar(df, head_rows=head_rows).collect()}
    sets = {i: {t[k : k + 4] for k in range(len(t) - 3)} for i, *_, t in rows}
    want, reps = {}, []
    for i, host, band, _, _ in sorted(rows, key=lambda r: r[3]):
        want[i] = next((j for j, h, b in reps if h != host and b == band and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.45), i)
        if want[i] == i:
            reps.append((i, host, band))
    assert got == want and len(reps) < len(rows) - 20


def test_anchored_merge_reads_whole_bodies(spark, tmp_path):
    rng = random.Random(2)
    a, b, c = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (1200, 6000, 6000))
    rows = [(0, a + b, "en", "s", 7200), (1, a + c, "en", "t", 7200), (2, a[::-1] + b, "en", "u", 7200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in similarity_plans.anchored_merge(spark, str(tmp_path)).collect()] == [(0, 2, 2)]


def test_quota_fill_and_forced(spark):
    rows = [(i, c, 1 + i % 3, i % 5 == 0, float(i), datetime(2024, 1, 1), i == 3) for i, c in enumerate(["a"] * 9 + ["b"] * 2 + ["c"] * 12)]
    df = spark.createDataFrame(rows, "id long, category string, priority int, urgent boolean, score double, published timestamp, manual boolean")
    got = selection.quota_select(df, per=5, total=15).collect()
    assert len(got) == 15 and any(r["id"] == 3 and r["pass"] == "forced" for r in got) and sum(r["category"] == "b" for r in got) == 2
    assert selection.quota_select(df.filter("false"), per=5, total=15).count() == 0


def test_lifecycle_span_cap_and_quiet():
    life = E.Lifecycle()
    steps = [life.step(h * 3600) for h in (0, 1, 8, 20, 25, 60)]
    assert [s["event_no"] for s in steps] == [1, 1, 1, 1, 2, 3]
    assert [s["reopened"] for s in steps] == [False, False, True, True, False, False]


def test_decisions_in_order():
    d, base = E.Decisions(), {"published": None, "groups": ["water"], "places": ["north"], "url": None, "target": "A"}
    say = lambda **x: d.step(base | x)["reason"]
    assert say(id=1, ts=0, event=1, url="u") == "new"
    assert say(id=2, ts=10, event=2, url="u") == "same url"
    assert say(id=3, ts=20, event=1) == "same event"
    assert say(id=4, ts=30, event=1, groups=["fire"]) == "update"
    assert say(id=5, ts=40, event=9) == "same place"
    assert say(id=6, ts=50, event=9, places=["south"]) == "new"
    assert say(id=7, ts=30 * 3600, event=9, published=20 * 3600) == "stale"
    later = d.step(base | {"id": 8, "ts": 60, "event": 9, "places": ["south"], "target": "B"})
    assert (later["reason"], later["update"], later["ref"]) == ("update", "b", 6)


def test_pacing_floor_and_ceiling():
    p = E.Pacing()
    for _ in range(200):
        low = p.step("ok")["interval_s"]
    for _ in range(20):
        high = p.step("refused")["interval_s"]
    assert (low, high) == (1.0, 120.0)


def drain(spark, query, table, rows):
    """Waits until a memory table has its rows; a query with processing-time timeouts never ends by itself."""
    end = time.time() + 150
    while time.time() < end and spark.table(table).count() < rows and query.isActive:
        time.sleep(0.5)
    failed = query.exception()
    query.stop()
    assert failed is None, failed


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 5, (i * 7919) % 400_000) for i in range(300)]
    rows.sort(key=lambda r: r[2])
    schema = "id long, key long, ts long"
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = folds.lifecycle_stream(stream).writeStream.format("memory").queryName("life").option("checkpointLocation", str(tmp_path / "cp")).start()
    drain(spark, q, "life", 300)
    order = ["id", "key", "event_no", "member", "reopened"]
    got = sorted(tuple(r[c] for c in order) for r in spark.table("life").collect())
    batch = E.ordered_fold(spark.createDataFrame(rows, schema), "key", ["ts", "id"], E.Lifecycle, lambda s, r: {"id": r["id"], "key": r["key"], **s.step(r["ts"])}, "id long, key long, event_no int, member int, reopened boolean")
    assert got == sorted(tuple(r[c] for c in order) for r in batch.collect())


@pytest.mark.parametrize(("gap", "keep_s"), [(0, None), (3 * 86400, None), (3 * 86400, 86400), (3 * 86400, 7 * 86400), (0, 3600)])
def test_decisions_stream_equals_batch(spark, tmp_path, gap, keep_s):
    """Desks silent for three days remember all of it, or what the retention leaves."""
    rng, name = random.Random(7), f"decided_{gap}_{keep_s}"
    at = lambda i: 1000 + i * 600 + i // 40 * gap
    rows = [(i, f"t{rng.randrange(2)}", at(i), None if i % 9 else at(i) - 8 * 3600, f"e{rng.randrange(9)}", f"u{rng.randrange(40)}", [f"g{rng.randrange(3)}"], [f"p{rng.randrange(3)}"], i % 2) for i in range(120)]
    schema = "id long, target string, ts long, published long, event string, url string, groups array<string>, places array<string>, desk int"
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : (k + 1) * 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = folds.decision_stream(stream, keep_s=keep_s).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    drain(spark, q, name, 120)
    names = ["id", "status", "reason", "ref", "update"]
    want = sorted(tuple(r[c] for c in names) for r in E.decide(spark.createDataFrame(rows, schema), "desk", keep_s).collect())
    assert sorted(tuple(r[c] for c in names) for r in spark.table(name).collect()) == want and {r[2] for r in want} >= {"new", "update", "stale"}
    if keep_s is None:
        assert sum(r[2] == "new" for r in want) <= 9 * 2 * 2 and "same url" in {r[2] for r in want}


def test_editions_by_day(spark):
    stories = spark.createDataFrame([("a", datetime(2024, 1, 1, 18, 0)), ("a", datetime(2024, 1, 1, 19, 0)), ("b", datetime(2024, 1, 2, 1, 0))], "section string, ts timestamp")
    days = {(str(r["start"]), r["section"]): r["n"] for r in folds.daily_editions(stories, "ts", "section").collect()}
    assert days == {("2023-12-31 18:30:00", "a"): 1, ("2024-01-01 18:30:00", "a"): 1, ("2024-01-01 18:30:00", "b"): 1}
    assert folds.rolling_editions(stories, "ts", "section").filter("section = 'a' and n = 2").count() == 23


def test_batches_and_first_picks(spark):
    rows = [(f"r{min(i % 7, 1)}" if i % 50 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "role string, k long")
    got = {r["k"]: (r["batch"], r["batches"]) for r in selection.numbered_batches(df, "role", [F.asc("k")], 60).collect()}
    for role in ("r0", "r1", None):
        own = [k for x, k in rows if x == role]
        assert [got[k] for k in own] == [(n // 60 + 1, -(-len(own) // 60)) for n in range(len(own))]
    pick = selection.first_per_group_first(df, "role", [F.asc("k")], 10).collect()
    assert [(r["k"], r["later"]) for r in pick] == [(0, False), (1, False), (7, False), *((k, True) for k in (2, 3, 4, 5, 6, 8, 9))]


def test_deduplicated_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 2)), ("b", datetime(2024, 1, 1))], "item_key string, discovered_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = folds.deduplicated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup").count() == 2


def test_guard_first_match_only(spark):
    p = ranking.Profile(names=["mira vale"], constituency_places=["oldport"], outside_places=["farcity"], commercial=["sale"], governance=["council"])
    rows = [
        (1, "mention", [], "news", "nothing here"), (2, "constituency", [], "farcity news", "farcity news"), (3, "political", ["party"], "x", "mira vale spoke"),
        (4, "district", ["district"], "big sale", "big sale"), (5, "district", ["district"], "big sale", "council big sale"), (6, "constituency", ["constituency"], "quiet", "quiet"),
    ]
    got = {r["id"]: (r["category"], r["guard"]) for r in ranking.guard(spark.createDataFrame(rows, "id long, category string, tags array<string>, title_norm string, text_norm string"), p).collect()}
    assert got == {1: ("none", "not named"), 2: ("none", "outside"), 3: ("mention", "named"), 4: ("none", "commercial"), 5: ("district", None), 6: ("constituency", None)}


def test_vocabulary_problems(spark):
    rows = [(1, "civic", "Flood*", "", "", "yes"), (2, "moon", "x", "", "", "yes"), (3, "area", "", "", "", "yes"), (4, "area", "y", "", "urgent", "yes"), (5, "civic", "z", "much", "", "yes"), (6, "civic", "flood*", "", "", "yes"), (7, "civic", "gone", "", "", "no")]
    raw = spark.createDataFrame(rows, "line long, tier string, term string, weight string, role string, active string").withColumns({"language": F.lit("en"), "group": F.lit(None).cast("string")})
    good, bad = sheets.vocabulary(raw)
    assert [(r["line"], r["weight"]) for r in good.collect()] == [(1, 2)]
    assert {r["line"]: r["problem"] for r in bad.collect()} == {2: "unknown tier", 3: "empty term", 4: "urgent outside civic and crime", 5: "weight is not a number", 6: "duplicate"}


def test_rerun_pairs_like_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    base = [([word() for _ in range(6)], [word() for _ in range(60)]) for _ in range(6)]
    rows = []
    for i in range(90):
        title, body = (list(x) for x in base[rng.randrange(6)])
        for part, n in ((title, rng.randint(0, 4)), (body, rng.randint(0, 12))):
            for _ in range(n):
                part[rng.randrange(len(part))] = word()
        rows.append((i, f"h{i % 3}", i % 2, "" if i % 13 == 0 else " ".join(title), " ".join(body), "OK" if i % 5 else "THIN"))
    df = merge.with_title_keys(spark.createDataFrame(rows, "id long, host string, band long, title string, body string, extract_status string"))
    old, new = df.filter("id < 45"), df.filter("id >= 45")
    got = {r["id"] for r in merge.drop_reruns(new, old, merge.rerun_pairs(new, old)).collect()}

    def jaccard(s, t):
        a, b = ({x[k : k + 4] for k in range(len(x) - 3)} for x in (s, t))
        return len(a & b) / len(a | b) if a and b else 0.0

    def again(x, y):
        ours = x[3] == y[3] != "" or x[2] == y[2] and jaccard(x[3], y[3]) >= 0.8
        return ours or x[2] == y[2] and x[5] == y[5] == "OK" and jaccard(x[4], y[4]) >= 0.8 and jaccard(x[3], y[3]) >= 0.3

    want = {x[0] for x in rows[45:] if not any(again(x, y) for y in rows[:45])}
    assert got == want and 0 < len(want) < 45


def test_similar_rows_of_one_side_never_meet(spark, monkeypatch):
    df = spark.createDataFrame([(i, "old" if i < 30 else "new", 0, [10, 20, 30, i % 4]) for i in range(60)], "id long, host string, band long, set array<long>")
    placed, units = similarity.size_blocks(df, 0.5, 8, apart=True)
    sides = placed.select("part", "host").distinct()
    assert sides.count() == 2 and units.filter("part_low = part_high").count() == 0 and units.count() == 16
    pairs = similarity.set_pairs(df, 0.99, True, 8, apart=True).collect()
    assert {(r["a"], r["b"]) for r in pairs} == {(a, b) for a in range(30) for b in range(30, 60) if a % 4 == b % 4}


def test_links_feeds_and_channels(spark):
    df = spark.createDataFrame([("see https://a.example/x portfolio positive and item:12 hidden, https://b.example/y",)], "t string")
    assert [(r["link"], r["category"], r["sentiment"]) for r in sheets.parse_links(df, "t").orderBy("place").collect()] == [("https://a.example/x", "portfolio", "positive"), ("item:12", None, None), ("https://b.example/y", None, None)]
    page = '{"items":[{"snippet":{"title":"t","publishedAt":"2024-01-02T03:04:05Z","resourceId":{"videoId":"abcdefghijk"},"thumbnails":{"high":{"url":"u"}}}}]}'
    got = feeds.video_entries(spark.createDataFrame([(page,), ("broken",)], "payload string")).collect()
    assert [(r["link"], r["image"], str(r["published_at"])) for r in got] == [("https://www.youtube.com/watch?v=abcdefghijk", "u", "2024-01-02 03:04:05")]


def test_publish_only_changes(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string"), str(tmp_path / "edition")
    assert sinks.publish_if_changed(df, path) and not sinks.publish_if_changed(df.orderBy(F.desc("id")), path)
    assert sinks.publish_if_changed(df.limit(1), path)


def test_upsert_and_reruns(spark):
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, p string, q string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, p string")
    assert sorted(tuple(r) for r in reports.upsert(old, new, "k").collect()) == [(1, "a", "x"), (2, "c", "y"), (3, "d", None)]
    rows = merge.with_title_keys(spark.createDataFrame([(1, "The bridge is closed"), (2, "The bridge is closed"), (3, "A new school opens")], "id long, title string"))
    none = spark.createDataFrame([], "id long, old_id long, body_sim double, title_sim double")
    assert [r["id"] for r in merge.drop_reruns(rows.filter("id > 1"), rows.filter("id = 1"), none).collect()] == [3]


@pytest.mark.parametrize("q", [0.5, 0.9])
def test_nearest_rank(spark, q):
    for n in (1, 2, 7, 10):
        xs = [(k * 37) % 11 for k in range(n)]
        df = spark.createDataFrame([(1, x) for x in xs], "g int, x int")
        want = sorted(xs)[int(q * (n - 1) + 0.5)]
        assert reports.nearest_rank_by(df, ["g"], "x", q, "v").first()["v"] == want == df.agg(reports.nearest_rank(F.col("x"), q)).first()[0]


def test_story_links_and_packing(spark):
    from siftline.operators import rendering, stories

    t = datetime(2024, 1, 1)
    rows = [(1, "Harbour tunnel flooding closes Oldport ferry", "a", []), (2, "Oldport ferry closed: harbour tunnel flooding", "a", []), (3, "School opens", "a", []), (4, "Oldport harbour tunnel flooding again", "a", ["south"]), (5, "Oldport harbour tunnel flooding again", "a", ["north"])]
    df = spark.createDataFrame([(i, x, c, "en", t, None, x.lower(), p) for i, x, c, p in rows], "id long, title string, category string, language string, published timestamp, story string, title_norm string, places array<string>")
    from siftline.functions.text import grams

    items = stories.with_core(df, ["again"]).withColumn("tgrams", grams(F.col("title_norm")))
    got = {(r["a"], r["b"]) for r in stories.linked(stories.word_links(items), items).collect()}
    assert (1, 2) in got and (4, 5) not in got and not any(3 in p for p in got)
    lines = spark.createDataFrame([("e", s, k, f"S{s}", "x" * 60) for s in range(3) for k in range(4)], "edition string, section_order int, line_order int, section string, line string")
    texts = [r["text"] for r in rendering.packed(lines, limit=200).orderBy("message").collect()]
    assert all(rendering.units(x) <= 200 for x in texts) and any("(continued)" in x for x in texts) and sum(x.count("x" * 60) for x in texts) == 12
    one = spark.createDataFrame([("A & B", "e" * 9000, "https://l", ["o"])], "t string, e string, l string, o array<string>")
    text = one.select(rendering.alert_text(F.col("t"), F.col("e"), F.col("l"), F.col("o"))).first()[0]
    assert rendering.units(text) <= 4000 and text.startswith("<b>A &amp; B</b>") and text.endswith("https://l")


def test_long_chains_are_decided_to_their_end(spark):
    for n, few in ((300, graph.FEW_LINKS), (12, 0)):
        ranked = spark.range(n).select("id", F.col("id").alias("rank"))
        edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        got = {r["id"]: r["representative"] for r in graph.greedy_representatives(ranked, edges, few_links=few).collect()}
        assert got == {k: k - k % 2 for k in range(n)}

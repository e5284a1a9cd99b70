"""Matching, event assignment, manual changes, hiding and SQL functions, on small rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import agents, matching, registry, text
from siftline.operators import assignment as A
from siftline.operators import candidates as C
from siftline.operators import selection, similarity
from siftline.plans import text_plans


def vocabulary(*rows, **more):
    return matching.Vocabulary.of([dict(zip(("tier", "term", "group", "role", "weight"), r, strict=False)) for r in rows], **more)


def test_stems_and_ends_of_words():
    spans = lambda term, text: matching.Term(term, "area", 1).spans(text)
    assert matching.stem("திருவள்ளூர்") == ("திருவள்ளூர", True) and matching.stem("ஆதம்பாக்கம்") == ("ஆதம்பாக்க", False)
    assert spans("திருவான்மியூர்", "திருவான்மியூரில் மழை") and spans("ஆதம்பாக்கம்", "ஆதம்பாக்கத்தில்")
    # A short word must end, or go on as its own forms do.
    assert spans("பலி", "இருவர் பலி") and spans("பலி", "பலியானார்") and not spans("பலி", "பலித்தது")
    assert spans("கொலை", "கொலைகள்") and spans("கொலை", "கொலைக்கு காரணம்") and spans("கொலை", "கொலைச் சம்பவம்")
    assert not spans("பள்ளம்", "பள்ளி") and spans("tras*", "trash trasy atras") == [(0, 5), (6, 11)]


def test_native_and_python_patterns_agree(spark):
    terms = [matching.Term(t, "area", 1) for t in ("பலி", "கொலை", "திருவள்ளூர்", "tras*", "mit license", "é", "u.s.")]
    texts = ["இருவர் பலி", "பலித்தது", "கொலைகள்", "கொலைக்கு", "திருவள்ளூரில்", "trashy", "the mit license.", "été", "éa", "u.s. army", "xu.s."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in terms:
        got = {r["t"]: r["x"] for r in rows.select("t", F.col("t").rlike(term.pattern).alias("x")).collect()}
        assert got == {t: bool(term.spans(t)) for t in texts}, term.text


def test_score_rules():
    v = vocabulary(("district", "oldport"), ("civic", "flood"), ("crime", "robbery"), ("collision", "other kumar"), ("veto", "film"), ("exclude", "oldport road", "", "exclude"), ("constituency", "northside"), named=r"\br\. kumar\b", titles=r"\bminister\b", mention=(r"minister", r"\bkumar\b"))
    say = lambda *x: matching.score_item(v, *x)
    assert (say("Oldport flood and robbery", "", "")["score"], say("Oldport flood and robbery", "", "")["band"]) == (5, "AI")  # context counts once
    assert say("Oldport road flood", "", "")["score"] == 0  # masked
    beside = say("Minister other Kumar visits Oldport", "", "")
    assert beside["veto"] == "collision:other kumar" and beside["band"] == "DROP" and "mention" in beside["tags"]
    assert say("Other Kumar visits Oldport, the longest of headlines", "", "")["veto"] is None
    assert say("Minister R. Kumar and other Kumar in Northside", "", "")["veto"] is None
    assert say("वर्षा oldport", "", "")["veto"] == "foreign-script" and say("वर्षा northside", "", "")["veto"] is None
    assert say("oldport film", None, None)["veto"] == "veto:film" and say(None, None, None)["band"] == "DROP"
    assert matching.score_item(v, "Oldport flood", "", "", has_ai=False)["band"] == "KEYWORD_KEEP"


def test_urgent_zones_and_excerpt():
    v = vocabulary(("district", "oldport", "old"), ("constituency", "northside"), ("civic", "flood", "water", "urgent"), ("crime", "theft", "theft", "context"), labels={"constituency": "NORTH", "district": "WIDE"})
    say = lambda *x: matching.urgent_item(v, *x)
    assert say("Oldport flood", "", "")["zone"] == "title" and say("Oldport", "", "a flood came")["zone"] == "title+lede"
    assert say("Flood", "", "in northside today")["target"] == "NORTH" and say("Oldport theft", "", "") is None
    far = "x " * 300
    body = say("News", "", far + "oldport had a flood " + far)
    assert body["zone"] == "body" and body["anchors"] == ["oldport"] and body["groups"] == ["water"]
    assert body["excerpt"].startswith("…x") and body["excerpt"].endswith("x…") and "oldport had a flood" in body["excerpt"] and len(body["excerpt"]) < 320
    assert say("News", "", f"oldport {far} flood") is None and say("News", "#oldport #flood", "") is None
    assert matching.place_ids(vocabulary(("district", "oldport", "oldport"), ("district", "puerto", "oldport"), ("district", "far", "east")), ["Puerto", "oldport", "far", "other"]) == ["district:far", "district:oldport", "other"]


def test_score_columns_match_rules_and_isolate_rows(spark, monkeypatch):
    v = vocabulary(("district", "oldport"), ("civic", "flood", "water", "urgent"))
    rows = [(1, "Oldport flood", None, "x"), (2, None, None, None), (3, "quiet", "", "nothing"), (4, "hidden old​port", None, "flood")]
    df = spark.createDataFrame(rows, "id int, title string, description string, body string").withColumn("scored", F.lit(1))
    got = {r["id"]: r["scored"] for r in matching.score_items(df, v).collect()}
    assert {i: (s["score"], s["band"], s["terms"]) for i, s in got.items()} == {i: tuple(matching.score_item(v, *x)[k] for k in ("score", "band", "terms")) for i, *x in rows}
    zones = {r["id"]: r["urgent"]["zone"] for r in matching.urgent_items(df, v).collect()}
    assert zones == {1: "title", 2: None, 3: None, 4: "title+lede"}


def test_terms_over_two_lines_are_scored(spark):
    v = vocabulary(("veto", "released under"), ("district", "old port"))
    df = spark.createDataFrame([(1, "x", None, "it was released\nunder a name"), (2, "x", None, "old  \tport"), (3, "old\u2003port", None, "")], "id int, title string, description string, body string")
    got = {r["id"]: (r["scored"]["score"], r["scored"]["terms"]) for r in matching.score_items(df, v).collect()}
    assert got == {1: (0, ["✖veto:released under"]), 2: (3, ["old port"]), 3: (3, ["old port"])}


def test_assignment_against_a_loop(spark):
    rng = random.Random(2)
    base = {k: "".join(rng.choice("abcdefgh ") for _ in range(600)) for k in range(6)}
    rows = []
    for i in range(80):
        body = base[rng.randrange(6)]
        rows.append((i, 1000 + i * 2400, f"h{rng.randrange(4)}", f"k{rng.randrange(12)}" if i % 5 == 0 else None, body[: 600 - rng.randrange(60)], "OK", 600))
    items = spark.createDataFrame(rows, "id long, ts long, host string, key string, body string, extract_status string, n_chars long")
    got = {r["id"]: (r["event"], r["joined"]) for r in A.assign_events(items).collect()}

    grams = {r[0]: registry.gram_set(r[4]) for r in rows}
    events, want, of = {}, {}, {}
    for i, ts, host, key, *_ in rows:
        now = -(-ts // 300) * 300
        is_open = lambda e: events[e][1] >= now - 86400 and events[e][0] >= now - 86400  # noqa: E731, B023
        same = [j for j, *r in rows[:i] if key and r[2] == key and is_open(of[j])]  # noqa: B023
        alike = [(-len(grams[i] & grams[j]) / len(grams[i] | grams[j]), j) for j, *r in rows[:i] if r[1] != host and is_open(of[j])]  # noqa: B023
        alike = [x for x in alike if x[0] <= -0.45]
        found = of[max(same)] if same else of[min(alike)[1]] if alike else None
        of[i] = i if found is None else found
        events[of[i]] = [events.get(of[i], [ts])[0], ts]
        want[i] = (of[i], found is not None)
    assert got == want and any(j for _, j in want.values())
    assert A.assign_events(items.limit(0)).count() == 0


def test_assignment_keeps_only_what_is_open(spark):
    fold, most = A.Assignment(), 0
    for i in range(5000):
        fold.step({"id": i, "ts": i * 3600, "now": i * 3600, "key": f"k{i}", "host": "h", "vertex": i, "matches": [(i, 1.0)]})
        most = max(most, len(fold.keys) + len(fold.members))
    assert most <= 2 * A.SWEEP_LEAST + 2 and len(fold.of) <= 25


def test_gram_sets_read_a_text_once(spark):
    rows = spark.createDataFrame([(1, "a", "abcdef"), (2, "b", "x"), (3, "a", None), (4, "b", "cdefgh" * 300)], "id long, host string, body string")
    sets = similarity.gram_sets(rows)
    assert sets._jdf.queryExecution().executedPlan().toString().count("EvalPython [") <= 1
    assert sorted((r["id"], len(r["set"]), len(r["bits"])) for r in sets.collect()) == [(1, 3, 512), (4, 6, 512)]


def test_clusters_of_copies_need_two_hosts(spark):
    rows = [(k, "a", "same words in every one of them") for k in range(5)] + [(10, "a", "another text that stands twice"), (11, "b", "another text that stands twice"), (12, "b", "same words in every one of these"), (13, "c", "alone")]
    df = spark.createDataFrame(rows, "id long, host string, body string")
    got = {r["id"]: r["component"] for r in similarity.duplicate_clusters(df, 0.6).collect()}
    assert got == {**dict.fromkeys([0, 1, 2, 3, 4, 12], 0), 10: 10, 11: 10}
    assert similarity.duplicate_clusters(df.filter("id < 5")).count() == 0


def test_titles_inside_others(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab é") for _ in range(n)) for n in (29, 30, 31, 45, 200)]
    titles = [*base, *(f"{x}{t}{y}" for t in base for x, y in (("", "z"), ("q", ""), ("qq", "zz"))), base[1], base[4][50:80], base[4][51:80], base[4][150:], "ab" * 40, "ab" * 16]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, ntitle string")
    got = sorted(tuple(r) for r in C.title_inside_links(df).collect())
    assert got == sorted((i, j) for i, s in enumerate(titles) for j, t in enumerate(titles) if s != t and len(s) >= 30 and s in t)


def test_anchors_are_few(spark):
    title = "".join(random.Random(5).choice("abcdefgh") for _ in range(4000))
    n = spark.createDataFrame([(title,)], "t string").select(F.size(C.title_anchors(F.col("t"))["keys"])).first()[0]
    assert n < 0.16 * len(title)  # every place was one before


def test_manual_changes(spark):
    log = [("a", None, None), ("a", "hide", None), ("a", "hide", None), ("a", "restore", None), ("a", "district", "negative"), ("a", "district", "negative"), ("b", "hide", None), ("b", "district", None), ("c", "restore", None)]
    rows = [(k, i, 100 + i, a, s, k == "c", False) for i, (k, a, s) in enumerate(log)] + [("d", 20, 120, None, None, False, True)]
    got = {(r["key"], r["seq"]): r for r in C.manual_fold(spark.createDataFrame(rows, "key string, seq long, ts long, asked string, sentiment string, known boolean, by_id boolean"), ["district"]).collect()}
    assert [got[("a", i)]["outcome"] for i in range(6)] == ["added", "hidden", "already", "restored", "updated", "already"]
    assert [got[("b", i)]["outcome"] for i in (6, 7)] == ["hidden", "restored"] and got[("c", 8)]["outcome"] == "kept" and got[("d", 20)]["outcome"] == "unknown"
    assert got[("a", 1)]["hidden"] and got[("a", 5)]["category"] == "district" and {got[("a", i)]["manual_at"] for i in range(6)} == {100}


def test_story_cards_and_urgent_block(spark):
    rows = [(1, "district", 1, True, 5.0, "2024-01-01", "x@1"), (2, "district", 1, False, 9.0, "2024-01-01", "x@1"), (3, "district", 2, False, 1.0, "2024-01-02", "plain"), (4, "district", 2, False, 1.0, "2024-01-02", "plain")]
    df = spark.createDataFrame(rows, "id long, category string, priority int, urgent boolean, score double, published string, story string")
    got = {r["id"]: r["merged"] for r in selection.one_card_per_story(df).collect()}
    assert got == {1: [1, 2], 3: [3], 4: [4]}
    assert {r["id"]: r["block"] for r in selection.urgent_block(df, ["district"]).collect()} == {1: "urgent", 2: "district", 3: "district", 4: "district"}


def test_page_head(spark, tmp_path):
    pages = ["""<meta content="A &ldquo;B&rdquo;" property="og:title"><title>no</title>""", "<TITLE>\n T &#233; | YouTube</TITLE>", """<meta name="description" content="it's">""", None]
    df = spark.createDataFrame([(p,) for p in pages], "p string")
    got = df.select(text.page_title(F.col("p")).alias("t"), text.page_description(F.col("p")).alias("d"), text.lead_image(F.col("p")).alias("i")).collect()
    assert [r["t"] for r in got] == ["A “B”", "T é", "", None] and got[2]["d"] == "it's" and got[0]["i"] is None
    cut = spark.createDataFrame([("<title>a &amp; b &quot;c &amp</title>",)], "p string").select(F.lit(1).alias("page_id"), F.col("p").alias("html"))
    cut.write.parquet(f"{tmp_path}/pages.parquet")
    assert text_plans.page_titles(spark, str(tmp_path)).first()["title"] == "a & b &quot;c &amp"  # as its SQL has it
    assert cut.select(text.page_title(F.col("html")).alias("t")).first()["t"] == 'a & b "c &'
    secure = spark.createDataFrame([("""<meta property='og:image:secure_url' content='https://x/y.png'>""",)], "p string")
    assert secure.select(text.lead_image(F.col("p")).alias("i")).first()["i"] == "https://x/y.png"


@pytest.mark.parametrize(("agent", "device", "browser"), [("Mozilla/5.0 (X11; Linux x86_64) HeadlessChrome/120.0", "Bot", "Other crawler"), ("Mozilla/5.0 (Windows NT 10.0) OPR/100.0 Chrome/115.0", "Desktop", "Opera"), (None, "Bot", "Script"), ("Mozilla/5.0 (Linux; Android 12; Tab) Chrome/99.0", "Tablet", "Chrome")])
def test_agents(spark, agent, device, browser):
    r = spark.createDataFrame([(agent,)], "ua string").select(*(c.alias(n) for n, c in agents.classify_agent(F.col("ua")).items())).first()
    assert (r["device"], r["browser"]) == (device, browser)


def test_sql_functions(spark):
    registry.register(spark, vocabulary(("district", "oldport"), ("civic", "flood", "water", "urgent")))
    r = spark.sql("SELECT norm_match(' A​B  c ') AS n, ngrams('Ab,cde') AS g, jaccard_sim('abcd', 'ABCDE') AS j, term_score('Oldport flood', '') AS s, urgent_zone('Oldport flood', '') AS z").first()
    assert (r["n"], r["g"], r["j"], r["s"], r["z"]) == ("ab c", ["ab c", "b cd", " cde"] and sorted(["ab c", "b cd", " cde"]), 0.5, 5, "title")
    got = spark.sql("SELECT * FROM parse_links('see https://a.example/x, district now; item:7 hide it http://b.example', 'district,hide')").collect()
    assert [(x["place"], x["link"], x["word"]) for x in got] == [(0, "https://a.example/x", "district"), (1, "item:7", "hide"), (2, "http://b.example", None)]
    assert spark.sql("SELECT norm_match(NULL) AS n, jaccard_sim('', NULL) AS j").first()[0:2] == (None, 0.0)


def test_shared_words_and_places(spark):
    rows = [(["flood", "ஆவடி"], ["floods", "ஆவடியில்"]), (["flood", "police"], ["police", "flood"]), (["ஆவடி"], ["ஆவடிபட்டினத்தில்"]), ([], ["x"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select(text.shared_words(F.col("a"), F.col("b")).alias("n"))
    assert [r["n"] for r in df.collect()] == [1, 2, 0, 0]
    table = {"avadi": ["ஆவடி", "Avadi"], "adambakkam": ["ஆதம்பாக்கம்"]}
    got = spark.createDataFrame([("in AVADI",), ("ஆதம்பாக்கத்தில்",), ("none",)], "t string").select(text.places(F.col("t"), table, matching.stem).alias("p")).collect()
    assert [r["p"] for r in got] == [["avadi"], ["adambakkam"], []]

"""Operators that learn or search: held-out accuracy and recall on the test tables, and odd cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import decontam, gru_lm, html_text, langid, toxicity
from siftline.llm.shared import might_be_in, top_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    rows = [(0, None, "en", "s", 0), (1, "", None, "s", 0), (2, "123 !!", "en", None, 6), (3, "the " * 60_000, "en", "s", 240_000), (3, "the " * 60_000, "en", "s", 240_000), (4, "é", "fr", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "row": F.lit(2), "has_letter": F.lit(True), "severity": F.lit(0)})


def test_language_accuracy(spark, data):
    got = langid.op4_language_bitmasks(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_cases(spark):
    rows = odd(spark)
    f = langid.learn(rows)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(rows, f).collect()}
    assert got[0] == got[1] == got[2] == "und"
    none = langid.learn(rows.limit(0))
    assert {r["lang_pred"] for r in langid.predict(rows, none).collect()} == {"und"}
    assert langid.keep_identified(rows, f, 0.2).columns == [c for c in rows.columns if c != "has_letter"]


def test_language_of_few_rows(spark):
    en, de = "the house is on the hill and the river runs below it", "das haus steht auf dem hügel und der fluss fließt darunter"
    rows = spark.createDataFrame([(i, en, "en") for i in range(20)] + [(20, de, "de"), (21, de, "de"), (22, "我们的房子在山上，河流在下面", "zh")], "doc_id long, text string, lang string")
    f = langid.learn(rows)
    assert f.languages == ["de", "en", "zh"]
    ask = spark.createDataFrame([(1, "the hill"), (2, "der fluss"), (3, "房子"), (4, "q"), (5, "7 7")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(ask, f).collect()}
    assert (got[1], got[2], got[3], got[5]) == ("en", "de", "zh", "und") and got[4] in f.languages
    alone = langid.learn(rows.filter("lang = 'de'"))
    assert {r["lang_pred"] for r in langid.predict(rows, alone).collect()} == {"de"}
    assert langid.predict(rows.limit(0), f).count() == 0


def test_ngrams_are_characters():
    raw = np.frombuffer("éa Ж，ok 中文字".encode(), np.uint8)
    at, code = langid.characters(raw)
    assert "".join(map(chr, code)) == "éa Ж，ok 中文字"
    row, h = langid.ngrams(raw, np.array([0, len(raw)]))
    # " éa ", " Ж，", "Ж，o" ...: four characters each; 中文, 文字 and "字 " two
    twos = langid.ngrams(np.frombuffer("中文字".encode(), np.uint8), np.array([0, 9]))[1]
    assert np.isin(langid.ngrams(np.frombuffer("中文".encode(), np.uint8), np.array([0, 6]))[1], h).any() and len(twos) == 3 + 1


def test_bit_slices_return_every_language():
    rng = np.random.default_rng(1)
    grams = {f"l{k:02d}": rng.integers(0, 2**63, 400, dtype=np.uint64) for k in range(70)}
    shared = np.array([12345], np.uint64)
    grams = {k: np.r_[v, shared] for k, v in grams.items()}
    f = langid.LanguageFilters.build(grams, slots=1 << 17)
    assert f.slots.shape[1] == 2
    mask = f.lookup(shared)[0]
    assert sum(int(m).bit_count() for m in mask) == 70
    for k, name in enumerate(f.languages):
        assert ((f.lookup(grams[name])[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()


def test_toxicity_ranks_and_cases(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    m = toxicity.learn(docs, labels.filter("doc_id % 3 <> 0"))
    assert (np.diff(m.thresholds) > 0).all()
    got = toxicity.score(docs, m).join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id").filter("doc_id % 3 = 0").toPandas()
    assert got.severity.between(0, 3).all() and got[got.truth == 0].toxic.mean() < 0.05
    assert got[got.truth == 1].severity.mean() > got[got.truth == 0].severity.mean() + 0.3
    rows = odd(spark)
    assert toxicity.score(rows, m).count() == rows.count()
    empty = toxicity.learn(rows, labels.limit(0))
    assert {r["toxic"] for r in toxicity.score(rows, empty).collect()} == {False}


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(3)
    grade = rng.integers(0, 4, 400)
    rows, cols = [], []
    for i, g in enumerate(grade):
        for f in range(3):
            if f < g:
                rows.append(i)
                cols.append(f)
        rows.append(i)
        cols.append(3 + int(rng.integers(0, 5)))
    w, t = toxicity.fit_ordinal(np.array(rows), np.array(cols), grade, 8)
    assert (w[:3] > 0.5).all() and np.abs(w[3:]).max() < w[:3].min() and (np.diff(t) > 0).all()


def test_benchmark_recall_and_paraphrase(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet")
    items = bench.collect()
    words = items[0]["text"].split()
    light = " ".join(w if k % 6 else "changed" for k, w in enumerate(words))
    extra = [(10_000, "Intro words here. " + light + " and an end."), (10_001, " ".join(sorted(words))), (10_002, None), (10_003, ""), (10_004, "the of " * 40_000)]
    rows = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in decontam.find_leaks(rows.withColumn("cosine", F.lit(1)), bench).collect()}
    want = {(r["doc_id"], x["item_id"]) for r in docs.collect() for x in items if x["text"] in (r["text"] or "")}
    found = {(i, k) for i, r in got.items() if i < 10_000 for k in r["item_ids"]}
    assert len(want & found) >= 0.9 * len(want) and not found - want
    assert got[10_000]["item_ids"] == [items[0]["item_id"]]
    assert not any(got[i]["contaminated"] for i in (10_001, 10_002, 10_003, 10_004))
    assert not any(r["contaminated"] for r in decontam.find_leaks(docs, bench.limit(0)).collect())


def test_common_subsequence():
    a, b = np.array([1, 2, 3, 4, 5], np.uint64), np.array([9, 1, 3, 2, 4, 5, 5], np.uint64)
    assert decontam.common_subsequence(a, b) == 4 and decontam.common_subsequence(a, b[:0]) == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Site name and slogan</a></header><nav><ul><li><a href=/a>Home page</a><li><a href=/b>All news</a></ul></nav>
<div class="cookie-notice">We use cookies on this site for you</div>{main}<aside>Related stories that are quite long and could be content</aside><form><p>Your mail address please<input></form>
<section id="comments"><p>First! What a great article this is, I like it a lot.</p></section><footer>&copy; 2024 Example</footer><script>var t="</p>";</script></body></html>"""


@pytest.mark.parametrize(
    ("main", "text"),
    [
        ("<article><header><h1>Big &amp; bold</h1></header><p>First paragraph of the story, long enough.</p><div class=ad>Buy now, it is cheap</div><p>No.</p><p>Last one <b>with</b>\n bold<i>er</i> text.</article>", "Big & bold First paragraph of the story, long enough. No. Last one with bolder text."),
        ("<div id=content><h1>Head line</h1><p>A first long paragraph that goes on for a while and on.<p>Short.<p>Another long paragraph that goes on for a while.</div>", "Head line A first long paragraph that goes on for a while and on. Short. Another long paragraph that goes on for a while."),
        ("", ""),
    ],
)
def test_html_main_text(main, text):
    assert html_text.main_text(PAGE.replace("{main}", main)) == text


def test_html_cases(spark):
    assert [html_text.main_text(x) for x in (None, "", "   ", "<p>", "plain words only")] == ["", "", "", "", "plain words only"]
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert html_text.main_text(deep) == "deep text"
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>é</p>"), (2, None, "<p>é</p>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()) == [(1, "", 0), (2, "é", 1), (2, "é", 1)]


def test_id_filter_loses_nothing(spark):
    docs, ids = spark.range(2000).select(F.col("id").alias("doc_id")), spark.range(0, 2000, 7)
    kept = {r["doc_id"] for r in might_be_in(docs, ids, bits=1 << 12).collect()}
    assert set(range(0, 2000, 7)) <= kept and len(kept) < 1500
    sized = {r["doc_id"] for r in might_be_in(docs, ids).collect()}
    assert set(range(0, 2000, 7)) <= sized and len(sized) < 700


def test_top_rows_cut_through_ties(spark):
    ties = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    more = ties.union(spark.createDataFrame([(1000, 9), (1001, 0), (1002, 7)], "k long, v int"))
    assert top_rows(ties, "v", 50, "k").count() == 50 and top_rows(ties, "v", 200, "k").count() == 100
    got = {r["k"] for r in top_rows(more, "v", 30, "k").collect()}
    assert len(got) == 30 and {1000, 1002} <= got and 1001 not in got
    near = spark.range(1000).select(F.col("id").alias("k"), (1000.0 + F.col("id") / 1000).alias("v"))
    assert {r["k"] for r in top_rows(near, "v", 10, "k").collect()} == set(range(990, 1000))
    assert top_rows(ties.limit(0), "v", 5, "k").count() == 0



def test_long_items_and_heavy_paraphrases_are_found(spark):
    rng = np.random.default_rng(4)
    common = [f"c{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(500)]
    share = 1 / np.arange(1, 501)
    text = lambda n: rng.choice(common, n, p=share / share.sum()).tolist()
    items = [text(n) for n in (16, 24, 40, 59, 100, 110, 169, 186, 250, 400)]
    docs = []
    for k, words in enumerate(items):
        kept = np.ones(len(words), bool)
        kept[rng.choice(len(words), len(words) * 3 // 10, replace=False)] = False
        light = [w if ok else "other" for w, ok in zip(words, kept, strict=True)]
        less = [w if ok and j % 2 else "other" for j, (w, ok) in enumerate(zip(words, kept, strict=True))]
        docs += [(3 * k, " ".join(text(300) + words + text(77))), (3 * k + 1, " ".join(text(33) + light + text(200))), (3 * k + 2, " ".join(less))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find_leaks(rows, bench).collect()}
    assert all(k in got[3 * k]["item_ids"] and k in got[3 * k + 1]["item_ids"] for k in range(len(items)))
    assert all(got[3 * k]["coverage"] == 1.0 and k not in got[3 * k + 2]["item_ids"] for k in range(len(items)))


def test_short_unspaced_and_many_items_are_found(spark):
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    share = 1 / np.arange(1, len(words) + 1)
    many = [" ".join(rng.choice(words, 40, p=share / share.sum())) for _ in range(1500)]
    items = [*enumerate(many), (5000, "What is 17 * 23?"), (5001, "法国的首都是哪个城市请回答"), (5002, "Paris"), (5003, "Name 1900, 1914.")]
    docs = [(k, f"zz yy {many[k]} xx") for k in range(0, 1500, 30)]
    docs += [(5000, "so what is 17*23 then"), (5001, "我问：法国的首都是哪个城市,请回答。好的"), (5002, "in Paris, yes"), (5003, "name 1900 and 1914"), (5004, "what is 17 * 24"), (5005, "法国城市"), (5006, "name"), (5007, "1900 1914")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.find_leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(k in got[k] for k in [*range(0, 1500, 30), 5000, 5001, 5002])
    assert not any(got[k] for k in (5003, 5004, 5005, 5006, 5007))


def test_terms_split_unspaced_scripts():
    raw = np.frombuffer("ab12 中文x、カ é。".encode() + "ก𠀀".encode(), np.uint8)
    t = decontam.Terms(raw, np.array([0, len(raw)]))
    assert [raw[a:b].tobytes().decode() for a, b in zip(t.start, t.end, strict=True)] == ["ab12", "中", "文", "x", "カ", "é", "ก", "𠀀"]


def test_network_learns_from_every_training_row(spark):
    """The second half by hash of doc_id, which a sample of 1,000 documents never held, has sentences of its own."""
    half = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < 500_000
    say = lambda x: " ".join(f"{x}{k}" for k in "abcdefgh")
    rows = spark.range(5000).toDF("doc_id").withColumn("text", F.repeat(F.when(half, say("p") + " ").otherwise(say("q") + " "), 12)).filter(~gru_lm.held_out(F.col("doc_id")))
    scorer = gru_lm.learn(rows.repartition(4), gru_lm.token_counts(rows))[0]
    score = lambda t: gru_lm.score_rows(scorer.model, *(lambda h, border, group: (scorer.look_up(h, group)[1], border))(*gru_lm.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))), scorer.end)[0]
    for x in "pq":
        assert score(f"{say(x)} {say(x)}") > score(" ".join(f"{x}{k}" for k in "hcfaebgdgcahdbfe")) + 5


LONG = "A long paragraph of the story that goes on for a while and says a lot of things, one after the other, until it ends."


@pytest.mark.parametrize(
    ("main", "text"),
    [
        (f"<div class=post><h1>Title</h1><div class=entry><p>{LONG}</p><p>{LONG}</p></div></div>", f"Title {LONG} {LONG}"),
        (f"<div class=post><div><h1>Title</h1><p>Short lead of it.</p></div><div class=entry>{f'<p>{LONG}</p>' * 12}</div><div><p>{LONG}</p></div></div>", " ".join(["Title Short lead of it.", *[LONG] * 13])),
        (f"<div class=wrap><div class=list><p><a href=/a>One</a></p><p><a href=/b>Two</a></p></div><div class=post><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div></div></div>", f"Title {LONG} {LONG}"),
    ],
)
def test_html_keeps_what_stands_beside_the_body(main, text):
    assert html_text.main_text(PAGE.replace("{main}", main)) == text


def test_space_is_the_leading_singular_space(spark):
    """Against numpy's SVD of the same matrix: the singular values, and what the truncated space keeps of the items."""
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)]
    topic = [rng.permutation(len(words))[:30] for _ in range(5)]
    texts = [" ".join(words[w] for w in rng.choice(topic[k % 5], 24)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts[40:])), "doc_id long, text string")
    frequency, n = decontam.document_frequencies(docs)
    idf = np.log((n + 1) / (frequency + 1)).astype(np.float32) + np.float32(1e-3)
    bench = decontam.build(docs, list(enumerate(texts[:40])), idf, n, rank=20)
    inside = bench.place[bench.place < len(bench.load) - 1]
    basis = np.zeros((decontam.DIMENSIONS, 20))
    basis[bench.place < len(bench.load) - 1] = bench.load[inside]
    basis /= idf[:, None]
    assert basis.shape[1] == 20 and np.allclose(basis.T @ basis, np.eye(20), atol=1e-3)

    def row(text):
        out = np.zeros(decontam.DIMENSIONS)
        out[np.unique(decontam.buckets(decontam.word_sequence(text)))] = 1
        return out * idf / np.sqrt((out * idf**2).sum())

    items, sample = np.stack([row(t) for t in texts[:40]]), np.stack([row(t) for t in texts[40:]])
    full = np.linalg.svd(np.vstack([items, sample * np.sqrt(0.5 * 40 / len(sample))]), compute_uv=False)
    assert np.allclose(bench.singular[:10], full[:10], rtol=0.02)
    kept = np.linalg.norm(items @ basis, axis=1)
    assert 0.7 < kept.mean() < 0.999  # truncated, not a rotation of the word space


def reworded(rng, n_items=40, concepts=300):
    """Documents that use two words for every concept side by side; items in first words; paraphrases that change half of them."""
    first, second = ([f"{mark}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(concepts)] for mark in "xy")
    docs = [" ".join(f"{first[c]} {second[c]}" for c in rng.choice(concepts, 12)) for _ in range(1500)]
    items, other = [], []
    for _ in range(n_items):
        c = rng.choice(concepts, 40, replace=False)
        change = np.arange(40) % 2 == 1
        change[34:] = False  # the answer
        items.append(" ".join(first[k] for k in c[:34]) + ". " + " ".join(first[k] for k in c[34:]))
        other.append(" ".join(second[k] if x else first[k] for k, x in zip(c, change, strict=True)))
    return docs, items, other


def test_paraphrases_in_other_words_are_found_through_the_space(spark, monkeypatch):
    rng = np.random.default_rng(12)
    docs, items, other = reworded(rng)
    rows = spark.createDataFrame([*enumerate(docs), *((10_000 + k, f"{docs[k]} {t} {docs[k + 1]}") for k, t in enumerate(other))], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = lambda: {(r["doc_id"], i) for r in decontam.find_leaks(rows, bench).collect() for i in r["item_ids"]}
    got = found()
    want = {(10_000 + k, k) for k in range(len(items))}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    real = decontam.build

    def without_space(*args, **more):
        made = real(*args, **more)
        idf = np.linalg.norm(made.load[:-1], axis=1, keepdims=True)
        flat = np.random.default_rng(1).normal(size=made.load.shape).astype(np.float32) / np.sqrt(made.load.shape[1])
        flat[:-1] *= np.where(idf > 0, 1, 0)
        flat[-1] = 0
        return decontam.Benchmark(made.ids, made.words, made.answers, made.place, flat, made.singular, made.short)

    monkeypatch.setattr(decontam, "build", without_space)
    assert len(found() & want) < 0.2 * len(want)


def test_recall_of_planted_paraphrases(spark):
    """Items in real documents with 28 % of their words replaced and others put between."""
    rng = np.random.default_rng(1)
    d = "/root/testdata/sf0.01"
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    texts = [r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").filter("n_chars > 2000").orderBy("doc_id").limit(200).collect()]
    words = " ".join(texts).split()
    any_word = lambda: words[rng.integers(len(words))]
    rows, want = [], set()
    for k, r in enumerate(bench.collect()):
        out = [x for w in r["text"].split() for x in ([w if rng.random() > 0.28 else any_word()] + ([any_word()] if rng.random() < 0.15 else []))]
        body = texts[k].split()
        rows.append((k, " ".join(body[:100] + out + body[100:])))
        want.add((k, r["item_id"]))
    df = spark.createDataFrame(rows + [(1_000 + k, t) for k, t in enumerate(texts[50:])], "doc_id long, text string")
    exact = {(i, x["item_id"]) for i, t in rows for x in bench.collect() if decontam.common_subsequence(decontam.word_sequence(x["text"]), decontam.word_sequence(t)) >= 0.7 * len(decontam.word_sequence(x["text"]))} & want
    got = {(r["doc_id"], i) for r in decontam.find_leaks(df, bench).collect() for i in r["item_ids"]}
    assert len(exact) > 15 and len(got & exact) >= 0.9 * len(exact)


def test_more_items_than_one_turn_holds(spark):
    """Searched in turns, the result is the same, and repeated rows stay rows of their own."""
    d = "/root/testdata/sf0.001"
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rows = docs.union(docs.filter("doc_id % 3 = 0"))
    key = lambda df: sorted((r["doc_id"], r["contaminated"], tuple(r["item_ids"])) for r in df.collect())
    one, turns = key(decontam.find_leaks(rows, bench)), key(decontam.find_leaks(rows, bench, most_items=15))
    assert len(one) == rows.count() and one == turns and any(x[1] for x in one)


def soup(html):
    """A page without tags, classes or links that tell what is what."""
    import re

    html = re.sub(r' class="ad"', "", re.sub(r"<(/?)(nav|article|footer)>", r"<\1div>", html))
    html = re.sub(r"<li><a[^>]*>([^<]*)</a></li>", r"<div><i>\1</i></div>", html)
    return re.sub(r"<(/?)(p|h1|ul)>", r"<\1div>", html)


def test_ratios_decide_on_pages_without_telling_tags(spark, monkeypatch):
    """On pages made of divs alone, the smoothed ratios find the text; without them the menus and adverts come along."""
    import collections

    def measured():
        out = []
        for html, want in pages:
            a, b = collections.Counter(html_text.main_text(html).split()), collections.Counter(want.split())
            both = sum((a & b).values())
            out.append((both / max(1, a.total()), both / max(1, b.total())))
        return np.array(out).mean(axis=0)

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    pages = [(soup(r["html"]), html_text.main_text(r["html"])) for r in rows]
    precision, recall = measured()
    assert precision > 0.92 and recall > 0.99
    with monkeypatch.context() as m:
        m.setattr(html_text, "smoothed", lambda r: np.ones(len(r)))
        assert measured()[0] < precision - 0.03
    with monkeypatch.context() as m:
        m.setattr(html_text, "cluster_marks", lambda v: np.ones(len(v), bool))
        assert measured()[0] < precision - 0.03
    with monkeypatch.context() as m:
        m.setattr(html_text, "smoothed", lambda r: r)
        assert measured()[1] < recall - 0.02


def test_html_of_the_test_pages_is_the_article(spark):
    """Brute force: what stands between the article's tags, without tags."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    want = [" ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", re.sub(r"</?b>", "", r["html"].split("<article>")[1].split("</article>")[0]))).split()) for r in rows]
    assert [html_text.main_text(r["html"]) for r in rows] == want


def test_html_long_deep_and_empty(spark):
    deep = "<article><p>Head of it.</p>" + "<div>" * 2000 + "deep text" + "</div>" * 2000 + "</article>"
    assert html_text.main_text(deep) == "Head of it. deep text"
    long = "<article>" + "<p>word</p>" * 60_000 + "</article>"
    assert html_text.main_text(long) == " ".join(["word"] * 60_000)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_grades_are_never_empty():
    step = lambda *x: toxicity.severity_steps(np.array(x), np.array(x)).tolist()
    assert step(1, 2, 3, 4, 5, 6) == [0, 0, 1, 1, 2, 2] and step(2, 2, 2) == [0, 0, 0] and step(0, 0, 0, 0, 5) == [0, 0, 0, 0, 1]
    assert step(1, 1, 1, 1, 2, 3) == [0, 0, 0, 0, 1, 1] or sorted(set(step(1, 1, 1, 1, 2, 3))) == [0, 1, 2]


def test_toxicity_empty_ties_and_repeats(spark):
    texts = spark.createDataFrame([(k, "you moron fool" if k % 2 else "a fine day", k % 2) for k in range(60)], "doc_id long, text string, toxic int")
    labels = texts.select("doc_id", "toxic")
    m = toxicity.learn(texts.select("doc_id", "text"), labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    assert len(m.thresholds) == 1  # equal texts: one grade of toxic rows
    rows = texts.union(texts.filter("doc_id = 1")).withColumn("grade", F.lit("x"))
    got = toxicity.score(rows, m).collect()
    assert len(got) == 61 and all(r["toxic"] == (r["doc_id"] % 2 == 1) and 0 <= r["severity"] <= 1 for r in got)
    assert len({(r["severity"], r["grade"]) for r in got if r["doc_id"] == 1}) == 1
    assert toxicity.score(texts.limit(0), m).count() == 0
    # Expected severity and grade by hand from the model's weights.
    one = toxicity.score(spark.createDataFrame([(1, "moron")], "doc_id long, text string"), m).first()
    row, col = m.features.find(*toxicity.text_features(np.frombuffer(b"moron", np.uint8), np.array([0, 5])))
    assert one["severity"] == pytest.approx(float((1 / (1 + np.exp(m.thresholds - m.weights[col].sum()))).sum()))


def test_leaks_on_empty_and_repeated_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (1, "one two three four five six seven eight nine ten"), (2, None), (3, "")], "item_id long, text string")
    rows = spark.createDataFrame([(5, "so one two three four five six seven eight nine ten it is"), (6, "nothing here")], "doc_id long, text string")
    got = decontam.find_leaks(rows.union(rows).withColumn("item_ids", F.lit(1)), bench).collect()
    assert len(got) == 4 and all(r["contaminated"] == (r["doc_id"] == 5) and set(r["item_ids"]) <= {1} for r in got)
    assert decontam.find_leaks(rows.limit(0), bench).count() == 0


def test_language_ties_and_empty_table(spark):
    rows = spark.createDataFrame([(k, "same words here", lang) for k, lang in enumerate(["xx", "aa", "mm"])], "doc_id long, text string, lang string")
    f = langid.learn(rows)
    assert {r["lang_pred"] for r in langid.predict(rows, f).collect()} == {"aa"}  # ties go to the first name
    assert langid.predict(rows.limit(0), f).count() == 0 and langid.keep_identified(rows.limit(0), f, 0.2).count() == 0

"""Operators with exact answers, against brute force on small fixtures."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from siftline.llm import arc_warc, gru_lm, minhash, mixing, mpeg_audio, registry, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({"marks": F.lit("x"), "unit": F.lit(1), "hash": F.lit(2), "component": F.lit(3), "rate": F.lit(4), "n_copies": F.lit(5)}) if extra else df


def sample_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(300)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = make(40)
    texts = [None, "", "   ", "a b", "a b", "x\0y" * 40, "x\0y" * 40, "é" * 200, "aaaa" * 100, "aaaa" * 90]
    for k in range(n):
        t = make(rng.choice([3, 30, 120]))
        if k % 4 == 0 and texts[-1]:
            t = " ".join(w if rng.random() > 0.03 else "edit" for w in texts[-1].split())
        if k % 7 == 0:
            t = f"{t} {passage} {make(5)}"
        if k % 11 == 0:
            t = texts[-1]
        texts.append(t)
    return texts


def brute_removed(texts, length=50):
    first = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        out.append((b, gone))
    return out


@pytest.mark.parametrize("hot", [2_000, 3])
def test_passages_like_brute_force(spark, monkeypatch, hot):
    texts = sample_texts()
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH", 50)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 200)
    texts.append((texts[40] or "") + "z" * 600_000)
    rows = docs(spark, texts, extra=True).repartition(3)
    rows = rows.union(rows.filter("doc_id % 10 = 1"))  # repeated rows
    got = {r["doc_id"]: r for r in suffix_dedup.digests(suffix_dedup.remove_repeats(rows)).collect()}
    for i, (b, gone) in enumerate(brute_removed(texts)):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), gone.sum(), spans, kept), i


def test_passages_keep_columns_and_characters(spark):
    texts = sample_texts(2)
    got = {r["doc_id"]: r for r in suffix_dedup.cut_texts(docs(spark, texts)).collect()}
    for i, (b, gone) in enumerate(brute_removed(texts)):
        if not gone.any():
            assert got[i]["text"] == texts[i]
        elif i in got:
            assert got[i]["n_chars"] == len(got[i]["text"]) and len(got[i]["text"].encode()) >= len(b) - gone.sum()
    assert suffix_dedup.cut_texts(docs(spark, texts).limit(0)).count() == 0
    assert suffix_dedup.cut_texts(docs(spark, texts)).columns == docs(spark, texts).columns


@pytest.mark.parametrize("step", [1, 2, 3, 6])
def test_merged_transform_is_the_sorted_order(step):
    rng = random.Random(4)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode() for _ in range(14)]
    strings = list(dict.fromkeys(strings))
    shards = [strings[:5], strings[5:]]
    (a, names_a), (b, names_b) = (suffix_dedup.ShardTransform.build(x) for x in shards)
    assert [shards[0][k] for k in names_a] == sorted(shards[0]) and [shards[1][k] for k in names_b] == sorted(shards[1])
    merged, lcp = suffix_dedup.merge_transforms(a, b, 6, step)

    rows = []
    for t, names, own in ((a, names_a, shards[0]), (b, names_b, shards[1])):
        string, offset, size = t.places
        assert size.tolist() == [len(own[k]) for k in names]
        rows += [own[names[x]][k : k + 6] for x, k in zip(string, offset, strict=True)]
    order = [rows[k] for k in merged]
    assert (np.diff(merged[merged < len(a.symbols)]) > 0).all() and (np.diff(merged[merged >= len(a.symbols)]) > 0).all()
    assert order == sorted(s[k : k + 6] for s in strings for k in range(len(s) - 5))
    for i in range(1, len(order)):
        shared = next((j for j in range(6) if order[i][j] != order[i - 1][j]), 6)
        assert lcp[i] == shared // step * step


def test_merging_decides_windows_like_a_dictionary():
    rng = random.Random(6)
    shards = [list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randint(4, 30))).encode() for _ in range(n))) for n in (20, 30)]
    built = [suffix_dedup.ShardTransform.build(x) for x in shards]
    docs = [np.array([rng.randrange(1000) for _ in x]) for x in shards]
    first = {}
    for own, doc in zip(shards, docs, strict=True):
        for s, d in zip(own, doc, strict=True):
            for k in range(len(s) - 7):
                first[s[k : k + 8]] = min(first.get(s[k : k + 8], 9999), d)
    got = suffix_dedup.first_documents(built[0][0], built[1][0], tuple(d[names] for d, (_, names) in zip(docs, built, strict=True)), 8)
    for (counts, values), own, (_, names) in zip(got, shards, built, strict=True):
        want = [[first[own[k][i : i + 8]] for i in range(len(own[k]) - 7)] for k in names]
        assert counts.tolist() == [len(x) for x in want] and values.tolist() == [y for x in want for y in x]


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()))
        sets.append({b" ".join(w)} if 0 < len(w) < k else {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)})
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(len(sets[i]), find(i)) for i in range(len(sets))]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 1_000_000), (5, 80, 1_000_000), (3, 85, 300)])
def test_near_duplicates_like_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rng = random.Random(8)
    base = [f"t{i}" for i in range(100)]
    texts = sample_texts(3) + [" ".join(w if rng.random() > 0.02 else f"e{rng.randrange(999)}" for w in base) for _ in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, texts, extra=True).repartition(3), k, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, k, percent)
    assert minhash.near_duplicates(docs(spark, texts).limit(0), k, percent).count() == 0


def test_hamming_keys_meet_within_the_bound():
    for similarity in (0.8, 0.85):
        d = minhash.distance_bound(similarity)
        chunks = minhash.chunk_bounds(d)
        assert d < 2 * len(chunks) and chunks[0][0] == 0 and chunks[-1][1] == minhash.POSITIONS


def test_mixing_matches_sql_and_cases(spark, duck, data):
    assert same(mixing.op8_poisson_mixing(spark, data).toPandas(), duck.sql(mixing.OP8_SQL).df())
    texts = ["a" * 50] * 300 + [None, ""]
    out = mixing.mix_sources(docs(spark, texts, extra=True), epochs=2.0)
    assert 450 < out.count() < 750 and out.columns.count("n_copies") == 1
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    only = mixing.mix_sources(docs(spark, texts), weights={"s1": 1.0})
    assert {r["source"] for r in only.select("source").distinct().collect()} == {"s1"}
    large = spark.createDataFrame([(i, "x", None) for i in range(40)], "doc_id long, text string, source string")
    assert abs(mixing.mix_sources(large, epochs=900.0).count() / 36000 - 1) < 0.05


@pytest.mark.parametrize("name", ["op6_arc_to_warc", "op7_multi_index_hamming"])
def test_queries_match_sql(spark, duck, data, name):
    assert same(registry.QUERIES[name](spark, data).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


def test_arc_cases(spark):
    odd = "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\nhttp://x 1.1.1.1 20040101000000 text/html 5\n" + "é" * 30
    pages = spark.createDataFrame([(1, "http://a/ b", None), (2, None, ""), (3, "http://a/c", odd), (4, "http://a/d", odd), (5, "http://a/e\nf", "z" * 300_000)], "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r["page_id"]: r for r in arc_warc.read_warc(spark, arc_warc.pages_to_warc(pages)).collect()}
    assert [(got[i]["record_type"], got[i]["refers_to"], got[i]["payload_bytes"]) for i in range(1, 6)] == [("revisit", 2, 0), ("response", None, 0), ("revisit", 4, len(odd.encode())), ("response", None, len(odd.encode())), ("response", None, 300_000)]
    assert got[3]["payload_digest"] == base64.b32encode(hashlib.sha1(odd.encode()).digest()).decode()
    assert arc_warc.read_warc(spark, arc_warc.pages_to_warc(pages.limit(0))).count() == 0
    import io

    v2 = arc_warc.arc_segment("x.arc", 2, [("http://a/", "20040101000000", b"HTTP/1.1 200 OK\r\n\r\nhi\n\n"), ("http://b/", "200401010000", b"plain")])
    records = list(arc_warc.read_arc(io.BytesIO(arc_warc.arc_segment("y.arc", 1, [("http://c/", "20040101000000", b"")]) + b"\n" + v2)))
    assert [r.version for r in records] == [1, 2, 2] and arc_warc.convert(records[1])["payload"] == "hi\n\n"
    with pytest.raises(ValueError, match="declares"):
        list(arc_warc.read_arc(io.BytesIO(v2[:-3])))


def test_audio_round_trip_and_damage(spark):
    texts = [None, "", "é" * 500, "x" * 192, "y" * 5000, "y" * 5000]
    got = {r["doc_id"]: r for r in mpeg_audio.media_features(mpeg_audio.encode_column(docs(spark, texts, extra=True))).collect()}
    for i, t in enumerate(texts):
        payload = mpeg_audio.padded((t or "").encode())
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(payload[-16:])
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["crc_bad"] == 0 and got[i]["duration_us"] == 24_000 * len(payload) // 192
    assert got[4]["media_sha256"] == got[5]["media_sha256"]
    payload = mpeg_audio.padded(b"z" * 4000)
    data = mpeg_audio.write_stream(payload, 4000)
    s = mpeg_audio.read_stream(data)
    assert mpeg_audio.stored_payload(data, s) == payload and s.table["frames"] == len(s.offsets) and s.tags["TXXX:n_bytes"] == "4000"
    cut = s.offsets[5]
    hurt = data[:cut] + b"\xff\xfb junk \xff" + data[cut:]
    again = mpeg_audio.read_stream(hurt)
    assert again.lost_bytes == 9 and again.resyncs == 1 and mpeg_audio.stored_payload(hurt, again) == payload
    flipped = bytearray(data)
    flipped[s.offsets[2] + 10] ^= 1
    assert mpeg_audio.read_stream(bytes(flipped)).crc_bad == 1
    vbri = mpeg_audio.read_table(bytes(36) + b"VBRI" + bytes(6) + (1000).to_bytes(4, "big") + (10).to_bytes(4, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(2) + (240).to_bytes(2, "big") * 2 + bytes(50), mpeg_audio.read_header(mpeg_audio.LOW))
    assert vbri == {"kind": "VBRI", "frames": 10, "bytes": 1000, "toc": [240, 240]}


def test_language_model_counts_and_gradient(spark):
    import collections
    import math

    texts = [t for t in sample_texts(5)]
    got = {r["doc_id"]: r for r in gru_lm.score_documents(docs(spark, texts, extra=True).repartition(2)).collect()}
    words = {i: re.findall(rb"[^\x20\x09-\x0d]+", bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode())) + [b"\0end"] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
    m = gru_lm.Gru.start(70, np.arange(70)[::-1], np.full(gru_lm.RARE, 9.0), hidden=3)
    for k, p in m.parts().items():
        setattr(m, k, p.astype(np.float64))
    rng = np.random.default_rng(0)
    word, h0 = rng.integers(0, 70 + gru_lm.RARE, (6, 4)), rng.normal(size=(4, 3))
    live = np.ones_like(word, bool)
    _, grads, _ = m.window_gradient(h0, word, live, 5)
    for k, at in (("back", (1, 2)), ("back_n", (0, 1)), ("gates", (int(word[1, 0]), 4)), ("class_w", (2, 1)), ("word_b", (0, 3))):
        p, e = getattr(m, k), 1e-5
        p[at] += e
        up = m.window_gradient(h0, word, live, 5)[0]
        p[at] -= 2 * e
        down = m.window_gradient(h0, word, live, 5)[0]
        p[at] += e
        assert grads[k][at] == pytest.approx((up - down) / (2 * e), rel=2e-3, abs=1e-4), k


def test_tokens_in_pieces_and_places_by_leading_bits(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [b"Ab c  d\xc3\xa9 zz\n" * int(rng.integers(0, 40)) for _ in range(200)] + [b"", b"x" * 5000, b""]
    flat, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = gru_lm.tokens(flat, off)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(gru_lm, "PIECE", piece)
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(whole, gru_lm.tokens(flat, off), strict=True))
    words = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    for known in (words, words[:1], np.r_[words[:9], np.uint64(2**64 - 1)], np.arange(50, dtype=np.uint64)):
        h = np.r_[rng.choice(known, 100), rng.integers(0, 2**64, 2000, dtype=np.uint64), np.uint64(0), np.uint64(2**64 - 1)]
        assert (gru_lm.Finder(known).places(h) == np.minimum(np.searchsorted(known, h), len(known) - 1)).all()


@pytest.mark.parametrize("scale", [1, 1000])
def test_losses_of_many_rows_are_those_of_each(scale):
    m = gru_lm.Gru.start(130, np.arange(130)[::-1], np.full(gru_lm.RARE, 9.0), hidden=4)
    m.class_w *= scale  # logits beyond MOST_LOGIT are cut
    rng = np.random.default_rng(4)
    h, word = rng.uniform(-1, 1, (2500, 4)).astype(np.float32), rng.integers(0, 130 + gru_lm.RARE, 2500)
    grads, each = ({k: np.zeros_like(v) for k, v in m.parts().items()} for _ in range(2))
    loss, d = m.losses(h, word, grads)
    one = [m.losses(h[i : i + 1], word[i : i + 1], each) for i in range(2500)]
    assert np.isfinite(loss).all() and np.allclose(loss, [x[0][0] for x in one], rtol=1e-4, atol=1e-4) and np.allclose(d, np.concatenate([x[1] for x in one]), rtol=1e-3, atol=1e-4 * scale)
    assert all(np.allclose(grads[k], each[k], rtol=1e-3, atol=1e-2) for k in grads)



def test_network_step_with_lanes_side_by_side():
    """Against the plain formula with states as rows; gates far beyond a float's range are 0, large logits give finite gradients."""
    rng = np.random.default_rng(11)
    m = gru_lm.Gru.start(70, np.arange(70)[::-1], np.full(gru_lm.RARE, 9.0), hidden=4)
    m.gates[3, :8] = -500
    gates, back, back_n = m.turned()
    assert gates.flags.c_contiguous and gates.shape == (12, 70 + gru_lm.RARE)
    h, word = rng.uniform(-1, 1, (5, 4)), np.array([3, 5, 90, 3, 60])
    given = m.gates[word].astype(float)
    z, r = (1 / (1 + np.exp(-(h @ m.back[:, c] + given[:, c]))) for c in (slice(0, 4), slice(4, 8)))
    n = np.tanh((r * h) @ m.back_n + given[:, 8:])
    with np.errstate(over="ignore"):
        got = m.step(h.T.astype(np.float32), gates.take(word, axis=1), back, back_n)
    for x, y in zip(got, (n + z * (h - n), z, r, n), strict=True):
        assert np.allclose(x, y.T, atol=1e-6)
    assert (got[1][:, 0] == 0).all()
    m.class_w[:] = 1000
    grads = {k: np.zeros_like(v) for k, v in m.parts().items()}
    assert all(np.isfinite(x).all() for x in (*m.losses(np.ones((5, 4), np.float32), word, grads), *grads.values()))


def test_model_is_a_distribution_and_lanes_agree():
    m = gru_lm.Gru.start(130, np.arange(130)[::-1], np.full(gru_lm.RARE, 9.0), hidden=4)
    h = np.random.default_rng(1).normal(size=(1, 4)).astype(np.float32)
    total = sum(np.exp(m.losses(h, np.array([w]))[0][0]) for w in range(130 + gru_lm.RARE))
    assert total == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(2)
    lengths = [1, 3, 90, 40, 7]
    border = np.r_[0, np.cumsum(lengths)]
    word = rng.integers(0, 130 + gru_lm.RARE, border[-1])
    word[word == 5] = 6
    word[border[1:] - 1] = 5
    one, many = gru_lm.score_rows(m, word, border, 5, lanes=1), gru_lm.score_rows(m, word, border, 5, lanes=4)
    assert np.allclose(one, many, atol=1e-3)


def test_language_model_empty_table(spark):
    assert gru_lm.score_documents(docs(spark, [])).count() == 0


def test_long_empty_and_repeated_rows(spark):
    """Very long texts, empty tables and repeated rows of the exact operators."""
    long = "word " * 150_000
    rows = docs(spark, ["a b c d e f", long, long + "x", None, ""])
    twice = rows.union(rows)
    audio = mpeg_audio.media_features(mpeg_audio.encode_column(twice)).collect()
    assert len(audio) == 10 and {r["payload_bytes"] for r in audio if r["doc_id"] == 1} == {len(mpeg_audio.padded(long.encode()))}
    assert mpeg_audio.media_features(mpeg_audio.encode_column(rows.limit(0))).count() == 0
    near = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(twice, 3, 85).collect()}
    assert near == {(0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True)}
    mixed = mixing.mix_sources(twice).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert all(r["n"] % 2 == 0 for r in mixed)
    scored = gru_lm.score_documents(twice).collect()
    assert len(scored) == 10 and len({(r["doc_id"], r["n_tokens"], round(r["base_score"], 6), round(r["score"], 4)) for r in scored}) == 5
    assert next(r["n_tokens"] for r in scored if r["doc_id"] == 1) == 150_001
    pages = spark.createDataFrame([(1, "http://a/", "z" * 9_000_000), (1, "http://a/", "z" * 9_000_000), (2, "http://b/", "y"), (3, "http://c/", "z" * 9_000_000)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in arc_warc.read_warc(spark, arc_warc.pages_to_warc(pages)).collect())
    assert got == [(1, "revisit", 3, 9_000_000), (1, "revisit", 3, 9_000_000), (2, "response", None, 1), (3, "response", None, 9_000_000)]

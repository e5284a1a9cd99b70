"""Line-first cleaning, word-trie resampling and the conversation trie, against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import same
from pyspark.sql import functions as F

from siftline.llm import line_rules, prefix_trie, registry, word_tries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CONV = "conv_id long, turn long, role string, text string"
BLANK = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", ["op11_line_first_cleaning", "op12_word_trie_resampling", "op13_conversation_trie"])
def test_matches_sql(spark, duck, data, name):
    assert same(registry.QUERIES[name](spark, data).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


def tables(spark, tmp_path, duck=None, **rows):
    """The given tables as Parquet, and DuckDB views of them."""
    con = duckdb.connect()
    for name, df in rows.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    return con


PLAIN = " ".join(f"plain{i} words{i}." for i in range(40))
ODD = [
    None, "", "  \n\t ", "  ", "one two three four.", "a b c a b c a b c. " * 9, "w " * 60, "x!! y!! z!! w!!", "Home\nHOME\nhome\n", f"A | B | C | D\n{PLAIN}",
    "All rights reserved.\n" * 3 + PLAIN, "12 34\n56", "é è ê.\r\né è ê.\r\n\n", "a\0b c\x1cd", "https://a.b www.c.d", "naïve 👍 line, that ends", "long " * 30_000, "Überschrift\nText, der bleibt und lang genug ist.",
]


def test_cleaning_odd_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(ODD)] + [(3, "one two three four.", "en", None, None), (None, "null id.", None, None, None)], DOCS)
    con = tables(spark, tmp_path, documents=docs)
    got = line_rules.op11_line_first_cleaning(spark, str(tmp_path)).toPandas()
    assert len(got) == len(ODD) + 2 and same(got, con.sql(line_rules.OP11_SQL).df())
    by = got.set_index("doc_id")
    assert by.loc[0, "base_failed"] and not by.loc[0, "kept"] and by.loc[9, "kept"] and by.loc[9, "n_navigation"] == 1
    assert by.loc[5, "n_repeat_words"] == 81 and by.loc[10, ["n_boilerplate", "n_dup_lines"]].tolist() == [3, 2]


def test_cleaning_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "Keep this line, it is long enough.\nHome\nA | B | C", "x", 7, 8)], "doc_id long, text string, row string, data int, stays int")
    out = line_rules.clean_lines(docs)
    row = out.first().asDict()
    assert row["clean_text"] == "Keep this line, it is long enough." and row["row"] == "x" and row["data"] == 7 and row["stays"] is True
    assert line_rules.clean_lines(docs.limit(0)).count() == 0


def test_repeated_words_like_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(0, 25))]
        times = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {p for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        assert line_rules.repeated_words(words) == len(covered)


def brute_resample(docs, goals, buckets, longest, percent=10, least=20):
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    runs = lambda w: [b" ".join(w[i : i + n]) for i in range(len(w)) for n in range(1, longest + 1) if i + n <= len(w)]
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(zlib.crc32(f) % buckets for f in runs(split(x)))
    for x in goals:
        t.update(zlib.crc32(f) % buckets for f in runs(split(x)))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        f = runs(split(x))
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in (zlib.crc32(k) % buckets for k in f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(split(x)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize(("longest", "buckets", "nodes"), [(1, 10_000, 400_000), (3, 500, 400_000), (3, 97, 50)])
def test_resampling_like_brute_force(spark, monkeypatch, longest, buckets, nodes):
    monkeypatch.setattr(word_tries, "MOST_NODES", nodes)
    rng = random.Random(longest)
    text = lambda n: " ".join(rng.choice(["Alpha", "beta-2", "É", "日本", "x_y", "Z9", "the", "of"]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 3, 25, 60]))) for i in range(300)] + [(500, None), (501, ""), (502, "word " * 40_000), (7, "repeated id " * 12), (None, "no id at all " * 9), (503, "\0a\x1fb c")]
    goals = [text(30), None, "", "日本 the of"]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, weight int").repartition(5)
    out = word_tries.resample(docs, spark.createDataFrame([(g,) for g in goals], "text string"), buckets=buckets, longest=longest)
    got = Counter(tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == brute_resample(rows, goals, buckets, longest)


def test_resampling_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert word_tries.resample(none, some).count() == 0
    assert word_tries.resample(some, none).first()["rank"] is None


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()), (r, x)))
    turns = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, b in sorted(built.items()):
        for d in range(len(b) + 1):
            members[b[:d]].append(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        saved = sum((len(members[q]) - 1) * len(re.findall(BLANK, q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        children = sum(len(x) == len(p) + 1 and x[: len(p)] == p for x in members)
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trie_like_brute_force(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), 120):
        n, kind = rng.choice([1, 2, 3, 6, 9]), rng.randrange(3)
        rows += [(c, t if rng.random() > 0.05 else None, rng.choice(["user", None]) if kind else "user", f"t{t} é w" if kind < 2 else rng.choice(["a b", "", None, "c"])) for t in range(n)]
    rows += [(400, 1, "u", "same"), (400, 1, "u", "same"), (400, 1, "u", "other"), (None, 1, "u", "no id"), (401, 0, "u", "x " * 50_000), *[(c, t, "u", f"copy {t}") for c in range(420, 440) for t in range(7)]]
    df = spark.createDataFrame([(*r, "n") for r in rows], f"{CONV}, node string").repartition(4)
    con = tables(spark, tmp_path, conversations=df)
    got = prefix_trie.op13_conversation_trie(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == brute_trie(rows)
    assert same(got.toPandas(), con.sql(prefix_trie.OP13_SQL).df())


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    turns = spark.createDataFrame([], "conv_id long, pos long, key binary, words long")
    assert prefix_trie.conversation_trie(turns, spark.createDataFrame([], "conv_id long, n_turns long")).count() == 0
    only = prefix_trie.conversation_trie(turns, spark.createDataFrame([(5, 0), (3, 0)], "conv_id long, n_turns long")).collect()
    assert [tuple(r) for r in only] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_places_spread_groups(spark):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).alias("g"), F.col("id").alias("v"), F.lit("x").alias("name"))
    from siftline.llm.shared import places

    got = places(df.repartition(7), ["g"], [F.desc("v")], "places-test").collect()
    for g in (None, 1):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: -r["v"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))

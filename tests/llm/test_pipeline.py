from __future__ import annotations

import random

import corpus_pipeline as P


def test_stages_in_turn(spark, tmp_path):
    rng = random.Random(5)
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bench = spark.read.parquet(f"{d}/benchmark.parquet").first()
    base = docs.filter("lang = 'en' and n_chars > 1500").first()["text"]
    words = base.split()
    near = " ".join(w if rng.random() > 0.01 else "edit" for w in words)
    more = [(90_000, "12 34", "en", "s", 5), (90_001, near, "en", "s", len(near)), (90_002, f"{base[:700]} {bench['text']} {base[900:1400]}", "en", "t", 1), (90_003, None, None, None, None)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    seen = {}
    for name, step in P.STAGES:
        out = step(spark, docs, d)
        if name != "mixing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not seen["language_id"] & {90_000, 90_003} and len(seen["language_id"]) > 190
    assert 90_001 in seen["language_id"] and 90_001 not in seen["near_dedup"]
    assert 90_002 in seen["passage_dedup"] and 90_002 not in seen["decontamination"]
    assert seen["mixing"] <= seen["decontamination"]


def test_near_dedup_stage_like_brute_force(spark):
    from test_exact import brute_components

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in rows.orderBy("doc_id").collect()]
    want = {i for i, (_, c) in enumerate(brute_components(texts, 5, 80)) if i == c}
    assert {r["doc_id"] for r in P.drop_near_duplicates(spark, rows, "").select("doc_id").collect()} == want


def test_stages_on_empty_repeated_and_clashing_rows(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    more = [(80_000, None, None, None, None), (80_001, "", "en", "", 0), (80_002, "long " * 120_000, "en", "s", 600_000)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    docs = docs.union(docs.filter("doc_id % 9 = 0"))
    clash = {c: F.lit("x") for c in ("marks", "packed", "is_copy", "component_id", "kept", "score", "lang_pred", "has_letter", "contaminated", "item_ids", "rate", "n_shingles")}
    for name, step in P.STAGES:
        wide = docs.withColumns(clash)
        out = step(spark, wide, d)
        assert set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}, name
        got, plain = out.select("doc_id", "text"), step(spark, docs, d).select("doc_id", "text")
        assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str), name
        times = {}
        for r in plain.collect():
            times[(r["doc_id"], r["text"])] = times.get((r["doc_id"], r["text"]), 0) + 1
        if name != "mixing":
            assert all(n == (2 if i % 9 == 0 else 1) for (i, _), n in times.items()), name
        assert step(spark, docs.limit(0), d).count() == 0, name

"""The stream of event assignment against its batch form, and its timers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_operators import drain

from siftline.operators import assignment as A
from siftline.streaming import assignment as S

ITEM = "id long, band long, ts long, host string, key string, body string, extract_status string, n_chars long"


@pytest.fixture
def rocks(spark):
    for k, v in S.state_settings().items():
        spark.conf.set(k, v)
    yield spark
    for k in S.state_settings():
        spark.conf.unset(k)


def reports(n=160, days=4, seed=5):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    stories = [[rng.choice(words) for _ in range(90)] for _ in range(12)]
    rows = []
    for i in range(n):
        story = rng.randrange(12)
        own = [w if rng.random() > rng.choice([0.02, 0.3]) else rng.choice(words) for w in stories[story]]
        body, band = " ".join(own), story % 2
        status = "OK" if rng.random() > 0.15 else "THIN"
        key = f"{band}-k{rng.randrange(8)}" if rng.random() < 0.2 else rng.choice([None, ""])
        rows.append((i, band, 1_700_000_000 + int(i / n * days * 86400) + rng.randrange(200), f"h{rng.randrange(4)}", key, body if rng.random() > 0.05 else None, status, len(body)))
    return sorted(rows, key=lambda r: (r[2], r[0]))


def test_stream_gives_what_batch_gives(rocks, tmp_path):
    rows = reports()
    end = (10_000, 0, rows[-1][2] + 3 * 86400, "h9", None, "far later", "OK", 9), (10_001, 1, rows[-1][2] + 3 * 86400, "h9", None, "far later", "OK", 9)
    for k in range(5):
        part = rows[k * 32 : (k + 1) * 32]
        rocks.createDataFrame(part, ITEM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for one in range(2):  # the clock goes on: both bands' timers are due
        moved = [(r[0] + 10 * one, r[1], r[2] + one * 86400, *r[3:]) for r in end]
        rocks.createDataFrame(moved, ITEM).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.assign_stream(stream).writeStream.format("memory").queryName("assigned").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    drain(rocks, q, "assigned", 164)
    out = rocks.table("assigned").collect()
    got = {(r["id"], r["event"], r["kind"] == "assigned") for r in out if r["kind"] in ("opened", "assigned") and r["id"] < 10_000}
    items = rocks.createDataFrame(rows, ITEM)
    want = {tuple(r) for b in (0, 1) for r in A.assign_events(items.filter(F.col("band") == b)).collect()}
    assert got == want and 20 < len({e for _, e, _ in got}) < 140
    closed = {r["event"]: r["at"] for r in out if r["kind"] == "closed"}
    first = {}
    for i, e, _ in want:
        first[e] = min(first.get(e, 1 << 60), next(r[2] for r in rows if r[0] == i))
    assert {e: t for e, t in closed.items() if e < 10_000} == {e: t + 86400 for e, t in first.items()}
    quiet = [r["event"] for r in out if r["kind"] == "quiet"]
    assert quiet and set(quiet) - {10_000, 10_001, 10_010, 10_011} <= set(first)
    kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert kept and kept[-1] < 25  # two open events, their reports and timers; all else is dropped


def test_copies_are_compared_once(spark):
    """Many copies of one report, from few hosts, over days: one vertex a day, no pairs of copies, and the same events as a plain fold."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    body = " ".join(rng.choice(words) for _ in range(90))
    other = " ".join(rng.choice(words) for _ in range(90))
    rows = [(i, 0, 1_700_000_000 + i * 600, f"h{i % 3}", f"k{i // 100}" if i % 9 == 0 else None, body if i % 5 else other, "OK", len(body)) for i in range(600)]
    items = spark.createDataFrame(rows, ITEM)
    of, pairs = A.near_vertices(items)
    assert pairs.count() <= 12 and of.select("vertex").distinct().count() <= 12
    got = {tuple(r) for r in A.assign_events(items).collect()}
    events, where, want = {}, {}, set()
    for i, _, ts, host, key, text, _, _ in sorted(rows, key=lambda r: (-(-r[2] // 300), r[2], r[0])):
        now = -(-ts // 300) * 300
        events = {e: t for e, t in events.items() if t[1] >= now - 86400 and t[0] >= now - 86400}
        alive = {j: w for j, w in where.items() if w[0] in events}
        same = [j for j, w in alive.items() if key and w[2] == key]
        alike = [j for j, w in alive.items() if w[3] == text and w[1] != host]
        event = alive[max(same)][0] if same else alive[min(alike)][0] if alike else i
        want.add((i, event, bool(same or alike)))
        first, last = events.get(event, (ts, ts))
        events[event] = (first, max(last, ts))
        where[i] = (event, host, key, text)
    assert got == want

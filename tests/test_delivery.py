"""Feed documents as a source; delivery with leases; the queue's replay."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest

from siftline.operators import delivery as D
from siftline.sources import feed_source as S
from siftline.streaming import delivery as L

RSS = "<rss><channel><item><title>A &amp; b</title><link> https://x/{0} </link><description>d</description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item><item><title>no link</title></item><item><link>https://x/{0}b</link></item>{1}"
END = "</channel></rss>"


def test_feed_forms():
    found, error = S.parse_feed(RSS.format(1, END).encode())
    assert error is None and [e["link"] for e in found] == ["https://x/1", "", "https://x/1b"] and found[0]["title"] == "A & b" and found[0]["body"] == "d"
    found, error = S.parse_feed(RSS.format(1, "<item><title>broken").encode())
    assert error and len(found) == 3
    assert S.parse_feed(b"")[0] == [] and S.parse_feed(b"no feed at all")[1]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:m="http://search.yahoo.com/mrss/"><entry><link rel="self" href="s"/><link href="https://v/1"/><title>t</title><content>c</content><m:group><m:description>md</m:description></m:group><updated>2024</updated></entry></feed>'
    assert S.parse_feed(atom.encode())[0] == [{"link": "https://v/1", "title": "t", "body": "md", "publisher": "", "published": "", "updated": "2024"}]
    name = S.landed_name(5, "a,b~c/d é", 200, 'W/"x,y"')
    assert S.parsed_name(name) == S.Landed(name, 5, "a,b~c/d é", 200, 'W/"x,y"') and S.parsed_name("other.txt") is None


def test_feed_stream_remembers_etags(spark, tmp_path):
    spark.dataSource.register(S.FeedDocuments)
    landing, out, cp = (str(tmp_path / x) for x in ("landing", "out", "cp"))
    polls = "polled_at long, source_id string, status int, etag string, body string"
    days = [
        [(1, "a", 200, "e1", RSS.format(1, END)), (2, "b", 200, None, RSS.format(2, END)), (3, "c", 500, None, "")],
        [(4, "a", 200, "e1", RSS.format(1, END)), (5, "b", 200, None, RSS.format(2, END)), (6, "a", 304, None, "")],
        [(7, "a", 200, "e2", RSS.format(3, END)), (8, "a", 200, "e1", RSS.format(4, "<x"))],
    ]

    def run():
        stream = spark.readStream.format("feed_documents").option("files", 1).load(landing)
        stream.writeStream.format("parquet").option("checkpointLocation", cp).option("path", out).trigger(availableNow=True).start().awaitTermination()

    for day in days:  # the query stops and goes on each time
        S.land(spark.createDataFrame(day, polls), landing)
        run()
    batch = {tuple(r) for r in spark.read.format("feed_documents").load(landing).collect()}
    streamed = spark.read.parquet(out).collect()
    assert {tuple(r) for r in streamed} == batch and len(streamed) == len(batch)
    unchanged = {r["polled_at"] for r in streamed if r["not_modified"]}
    assert unchanged == {4, 6} and {r["polled_at"] for r in streamed if r["place"] is not None} == {1, 2, 5, 7, 8}
    assert {r["polled_at"] for r in streamed if r["error"]} == {3, 8}


def fails(log, trap=None, bad=None):
    """A transport that writes down what it sent, and breaks before one of the ids while a file says so."""
    log, bad = str(log), bad or {}

    def transport(row):
        if row["id"] == trap and os.path.exists(log + ".trap"):
            raise RuntimeError("killed")
        said = bad.get((row["id"], row["attempts"]), "ok")
        with open(log, "a") as f:
            f.write(json.dumps([row["id"], said]) + "\n")
        return said, None

    return transport


def sent(log):
    return [i for i, said in map(json.loads, Path(log).read_text().splitlines()) if said == "ok"] if os.path.exists(log) else []


ROWS = [(i, f"c{i % 2}", "URGENT" if i % 3 else "DIGEST", i % 2, 1000, f"text {i}") for i in range(10)]


def test_a_killed_batch_sends_nothing_twice(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    rows = spark.createDataFrame(ROWS, L.ROW)
    Path(f"{log}.trap").write_text("")
    run = lambda number, now, df=rows: L.deliver_batch(df, number, ledger, fails(log, trap=5), clock=lambda: now)
    with pytest.raises(Exception, match="killed"):
        run(0, 1100)
    before = sent(log)
    assert 5 not in before
    os.remove(f"{log}.trap")
    run(0, 1101)  # the batch again: 5 may have gone out, so it waits
    none = spark.createDataFrame([], L.ROW)
    run(1, 1102, none)
    assert sorted(sent(log)) == [0, 1, 2, 3, 4, 6, 7, 8, 9] and len(set(sent(log))) == 9
    assert run(2, 1102 + L.LEASE_S, none) == 1 and run(3, 1103 + L.LEASE_S, none) == 0
    assert sorted(sent(log)) == list(range(10))


def test_holds_and_retries(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    bad = {(1, 0): "rate", (4, 0): "server", (4, 1): "server"}
    run = lambda number, now, rows: L.deliver_batch(spark.createDataFrame(rows, L.ROW), number, ledger, fails(log, bad=bad), clock=lambda: now)
    own = [r for r in ROWS if r[1] == "c0"]
    assert run(0, 1100, own) == 0 or sent(log)  # the channel stops at 4, which is retried later
    run(1, 1110, [])
    assert 4 not in sent(log)
    run(2, 1100 + 60, [])
    run(3, 1100 + 60 + 120, [])
    assert 4 not in sent(log) or sent(log).count(4) == 1
    bad.clear()
    run(4, 3000, [])
    assert sorted(sent(log)) == [0, 2, 4, 6, 8]
    other = str(tmp_path / "other")
    late = [(70, "c9", "URGENT", 0, 1, "late")]
    assert L.deliver_batch(spark.createDataFrame(late, L.ROW), 0, other, fails(log), clock=lambda: 1 + D.EXPIRE_S + 5) == 0
    assert [r["status"] for r in L.latest(L.marks(spark, other)).collect()] == ["EXPIRED"]


def test_what_failures_cost():
    assert D.after("server", 5, 0).status == "FAILED" and D.after("server", 4, 10) == ("PENDING", 5, 10 + 900, 0, True)
    assert D.after("config", 2, 10) == ("PENDING", 2, 910, 910, True) and D.after("parse", 0, 1).status == "SENT"
    assert D.after("unknown", 0, 1).status == "FAILED"

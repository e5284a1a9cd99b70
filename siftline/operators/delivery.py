"""The delivery queue of a channel: what is sent when, retried, held back, given up.

At every tick a channel's due rows go out by priority, urgent ones first, until something stops it: a
refused rate holds the channel for 30 seconds, a refused set-up for 15 minutes, other failures only wait for
the next tick while the row itself waits longer and longer. `replay` runs the queue over ticks of a virtual clock; the
live form with leases and a ledger is siftline.streaming.delivery.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values, in seconds: how long a row may wait to be sent, and what each kind of failure costs.
EXPIRE_S, RATE_S, NETWORK_S, CONFIG_S, MOST_WAIT_S = 12 * 3600, 30, 60, 900, 900
MOST_ATTEMPTS = 6
FINAL = ("SENT", "FAILED", "EXPIRED", "SUPPRESSED")
OUTCOMES = ("ok", "rate", "network", "config", "server", "parse")


class After(NamedTuple):
    """What becomes of a row after a send: its status, attempts, when it is due again, until when its channel is held, and whether the channel stops for this tick."""

    status: str
    attempts: int
    due: int
    hold: int
    stops: bool


def after(outcome: str, attempts: int, now: int) -> After:
    """outcome is one of OUTCOMES; a markup error is sent again as plain text, which counts as sent."""
    if outcome in ("ok", "parse"):
        return After("SENT", attempts + 1, 0, 0, False)
    if outcome == "rate":
        return After("PENDING", attempts, now + RATE_S, now + RATE_S, True)
    if outcome == "network":
        return After("PENDING", attempts, now + NETWORK_S, 0, True)
    if outcome == "config":
        return After("PENDING", attempts, now + CONFIG_S, now + CONFIG_S, True)
    if outcome == "server" and attempts + 1 < MOST_ATTEMPTS:
        return After("PENDING", attempts + 1, now + min(MOST_WAIT_S, 30 * 2 ** (attempts + 1)), 0, True)
    return After("FAILED", attempts + 1, 0, 0, False)


class Channel:
    """One channel's open rows; `tick` gives (id, at, status, attempts, outcome) per change."""

    def __init__(self, outcome: Callable[[int, int], str], most: int):
        self.outcome, self.most = outcome, most  # outcome(id, sends so far): what the transport answers
        self.open: dict[int, dict] = {}
        self.hold = 0

    def add(self, row: dict) -> None:
        self.open[row["id"]] = {"order": (row["priority"], row["rank"], row["id"]), "created": row["ts"], "due": 0, "attempts": 0, "sends": 0}

    def tick(self, now: int) -> Iterator[tuple]:
        for i in sorted(i for i, r in self.open.items() if now - r["created"] > EXPIRE_S):
            yield i, now, "EXPIRED", self.open.pop(i)["attempts"], None
        if now < self.hold:
            return
        for _ in range(self.most):
            due = [(r["order"], i) for i, r in self.open.items() if r["due"] <= now]
            if not due:
                return
            i = min(due)[1]
            r = self.open[i]
            said = self.outcome(i, r["sends"])
            then = after(said, r["attempts"], now)
            r["sends"], r["attempts"], r["due"] = r["sends"] + 1, then.attempts, then.due
            self.hold = max(self.hold, then.hold)
            if then.status in FINAL:
                del self.open[i]
            yield i, now, then.status, then.attempts, said
            if then.stops:
                return


def replay(queue: DataFrame, ticks: DataFrame, outcome: Callable[[int, int], str], most: int = 20) -> DataFrame:
    """(channel, id, at, status, attempts, outcome): every change of a queue's rows (channel, id, ts, priority, rank) at its channels' ticks (channel, ts), in order of time.

    A row that comes at a tick's own second goes with that tick.
    """
    none = F.lit(None).cast("long")
    marks = ticks.select("channel", none.alias("id"), F.col("ts").cast("long").alias("ts"), F.lit(0).alias("priority"), F.lit(0).alias("rank"), F.lit(1).alias("mark"))
    rows = queue.select("channel", F.col("id").cast("long").alias("id"), F.col("ts").cast("long").alias("ts"), F.col("priority").cast("int").alias("priority"), F.col("rank").cast("int").alias("rank"), F.lit(0).alias("mark"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, channel = object(), None
        for p in parts:
            out = []
            for row in p.to_dict("records"):
                if row["channel"] != name:
                    name, channel = row["channel"], Channel(outcome, most)
                if row["mark"]:
                    out += [(name, *x) for x in channel.tick(row["ts"])]
                else:
                    channel.add({**row, "id": int(row["id"])})
            if out:
                yield pd.DataFrame(out, columns=["channel", "id", "at", "status", "attempts", "outcome"])

    both = rows.union(marks).repartition("channel").sortWithinPartitions("channel", "ts", "mark", "id")
    return both.mapInPandas(run, "channel long, id long, at long, status string, attempts int, outcome string")

"""Event life cycles, alert decisions, pacing and delivery: ordered folds over a key's rows.

A fold is a plain object with `step(row) -> row`. In batch, rows are partitioned and sorted
by key and time and streamed through; a task holds one key's state, never its rows. The
streaming form (siftline.streaming) drives the same object with stored state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3600
QUIET_S, CLOSE_S, SPAN_S = 6 * HOUR, 24 * HOUR, 24 * HOUR
STALE_S, PLACE_S = 6 * HOUR, 3 * HOUR


class Lifecycle:
    """Reports of one key to events: a report opens one, or joins the open one unless that has been silent, or is, 24 hours old."""

    def __init__(self, saved: dict | None = None):
        self.first = self.last = None
        self.number = 0
        self.members = 0
        self.__dict__.update(saved or {})

    def step(self, ts: int) -> dict:
        fresh = self.first is None or ts - self.last >= CLOSE_S or ts - self.first >= SPAN_S
        quiet = not fresh and ts - self.last >= QUIET_S
        if fresh:
            self.number, self.first, self.members = self.number + 1, ts, 0
        self.last, self.members = ts, self.members + 1
        return {"event_no": self.number, "member": self.members, "reopened": quiet}


class Decisions:
    """Alert decisions of one desk: stale, same url, same event, same place, update or new.

    State: the alerts so far, by url and by event, and those of the last three hours. An alert is
    forgotten when it is more than keep_s older than the row at hand, never without keep_s.
    """

    def __init__(self, saved: dict | None = None, keep_s: int | None = None):
        self.urls: dict[str, list[int]] = {}  # url -> id and time of its first alert
        self.events: dict[str, list[dict]] = {}  # event -> its alerts: id, ts, target, groups
        self.recent: list[dict] = []  # id, ts, target, groups, places
        self.keep_s, self.swept = keep_s, None
        self.__dict__.update(saved or {})

    def sweep(self, ts: int) -> None:
        """Drops what is forgotten, a few times per retention; until then it is only passed over."""
        if self.keep_s is None:
            return
        if self.swept is None:
            self.swept = ts
        if ts - self.swept > self.keep_s / 4:
            self.swept = ts
            self.urls = {u: x for u, x in self.urls.items() if self.alive(x[1], ts)}
            live = {e: [a for a in own if self.alive(a["ts"], ts)] for e, own in self.events.items()}
            self.events = {e: own for e, own in live.items() if own}

    def alive(self, then: int, ts: int) -> bool:
        return self.keep_s is None or ts - then <= self.keep_s

    def step(self, row: dict) -> dict:
        """row: id, ts and published (seconds), target, event, url, groups, places. ts is the clock of the batch."""
        ts, groups, places = row["ts"], sorted(set(row["groups"] or [])), set(row["places"] or [])
        self.sweep(ts)
        self.recent = [a for a in self.recent if ts - a["ts"] <= PLACE_S]
        own = [a for a in self.events.get(row["event"], []) if self.alive(a["ts"], ts)] if row["event"] is not None else []
        near = [a for a in self.recent if a["target"] == row["target"] and places & set(a["places"]) and self.alive(a["ts"], ts)]
        first = self.urls.get(row["url"]) if row["url"] else None
        published = ts if row["published"] is None else row["published"]
        status, reason, ref, new = "PENDING", "new", None, []
        if ts - published > STALE_S:
            status, reason = "SUPPRESSED", "stale"
        elif first and self.alive(first[1], ts):
            status, reason, ref = "SUPPRESSED", "same url", first[0]
        elif own or near:
            told = {g for a in own or near for g in a["groups"]}
            new = [g for g in groups if g not in told]
            if own and row["target"] not in {a["target"] for a in own}:
                new.append(row["target"].lower())
            ref = own[0]["id"] if own else near[-1]["id"]
            reason = "update" if new else "same event" if own else "same place"
            status = "PENDING" if new else "SUPPRESSED"
        if status == "PENDING":
            if row["event"] is not None:
                self.events[row["event"]] = self.shortened([*own, {"id": row["id"], "ts": ts, "target": row["target"], "groups": groups}])
            self.recent.append({"id": row["id"], "ts": ts, "target": row["target"], "groups": groups, "places": sorted(places)})
            if row["url"]:
                self.urls[row["url"]] = [row["id"], ts]
        return {"status": status, "reason": reason, "ref": ref, "update": ",".join(new)}

    def shortened(self, own: list[dict]) -> list[dict]:
        """Without retention one entry says all about an event: the first alert with every group, and one per further target."""
        if self.keep_s is not None:
            return own
        targets = list(dict.fromkeys(a["target"] for a in own))
        groups = sorted({g for a in own for g in a["groups"]})
        return [{**own[0], "target": t, "groups": groups if t == targets[0] else []} for t in targets]


class Pacing:
    """Seconds between requests: half a second less after 15 clean ones (1 at least), three times on a refusal, half as much again on an error (120 at most)."""

    def __init__(self, saved: dict | None = None):
        self.interval, self.clean = 2.0, 0
        self.__dict__.update(saved or {})

    def step(self, outcome: str) -> dict:
        if outcome == "ok":
            self.clean += 1
            if self.clean >= 15:
                self.interval, self.clean = max(1.0, self.interval - 0.5), 0
        else:
            self.interval, self.clean = min(120.0, self.interval * (3 if outcome == "refused" else 1.5)), 0
        return {"interval_s": self.interval, "clean": self.clean}


def ordered_fold(df: DataFrame, key: str, order: list[str], make: Callable, step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """step(make(), row) over each key's rows in order; schema is that of what step returns."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for p in parts:
            out = []
            for row in p.to_dict("records"):
                if row[key] != now:
                    now, state = row[key], make()
                out.append(step(state, row))
            if out:
                yield pd.DataFrame(out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def lifecycle(reports: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """(id, key, event_no, member, reopened) per report; ts in epoch seconds."""
    ready = reports.select(F.col(row_id).alias("id"), F.col(key).alias("key"), F.col(ts).alias("ts"))
    return ordered_fold(ready, "key", ["ts", "id"], Lifecycle, lambda s, r: {"id": r["id"], "key": r["key"], **s.step(r["ts"])}, "id long, key long, event_no int, member int, reopened boolean")


DECIDED = "id long, target string, status string, reason string, ref double, update string"


def decision_step(s: Decisions, r: dict) -> dict:
    """One report as a frame's row has it, with its id and target."""
    listed = lambda x: [] if x is None else list(x)
    none = lambda x: None if x is None or x is pd.NaT or x != x else x
    published = none(r["published"])
    clean = {"ts": int(r["ts"]), "published": None if published is None else int(published), "event": none(r["event"]), "url": none(r["url"]), "groups": listed(r["groups"]), "places": listed(r["places"])}
    return {"id": r["id"], "target": r["target"], **s.step({**r, **clean})}


def decide(reports: DataFrame, desk: str = "target", keep_s: int | None = None) -> DataFrame:
    """(id, target, status, reason, ref, update) for rows (id, target, ts, published, event, url, groups, places).

    A desk's rows are decided in order, so an event, a url or a place that must be seen
    together belongs to one desk. keep_s is the retention, the same as decision_stream's.
    """
    keyed = reports.withColumn("desk_key", F.col(desk))
    out = ordered_fold(keyed, "desk_key", ["ts", "id"], lambda: Decisions(keep_s=keep_s), decision_step, DECIDED)
    return out.withColumn("ref", F.col("ref").cast("long"))


def pacing(log: DataFrame, key: str, ts: str, row_id: str, outcome: str) -> DataFrame:
    ready = log.select(F.col(row_id).alias("id"), F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(outcome).alias("outcome"))
    return ordered_fold(ready, "key", ["ts", "id"], Pacing, lambda s, r: {"id": r["id"], "key": r["key"], **s.step(r["outcome"])}, "id long, key long, interval_s double, clean int")


def silent_sessions(reports: DataFrame, key: str, ts: str, gap_s: int = QUIET_S) -> DataFrame:
    """Sessions that end with gap_s of silence, as window functions: (key, session, reports, first, last)."""
    from pyspark.sql import Window as W

    rows = W.partitionBy(key).orderBy(ts)
    fresh = (F.col(ts) - F.lag(ts).over(rows) >= gap_s).cast("int")
    numbered = reports.withColumn("session", F.sum(F.coalesce(fresh, F.lit(0))).over(rows.rangeBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("reports"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def retry(kind: Column, attempts: Column) -> dict[str, Column]:
    """What becomes of a failed delivery: status, seconds to wait, and whether the attempt counts."""
    wait = F.when(kind == "rate", 30).when(kind == "network", 60).when(kind == "config", 900).when(kind == "server", F.least(F.lit(900), (30 * F.pow(F.lit(2), attempts)).cast("int"))).otherwise(0)
    status = F.when(kind == "ok", "SENT").when((kind == "server") & (attempts >= 6), "FAILED").when(kind == "parse", "PLAIN").otherwise("PENDING")
    return {"status": status, "wait_s": wait, "counts": kind.isin("server", "parse")}


def saved(fold: object) -> str:
    return json.dumps(fold.__dict__)


def restored(kind: Callable, text: str | None) -> object:
    return kind(json.loads(text) if text else None)

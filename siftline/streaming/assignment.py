"""Event assignment as a stream: open events with an inverted index of their reports' grams, closed by event-time timers.

One state instance per band (a language, a region): reports of different bands never share
an event. What a report joins is decided as operators.assignment decides it, in order of
ticks; the state is only what is open. Timers set to the next change of an event
emit QUIET and CLOSED and drop a closed event's reports, keys and postings, so
state is bounded by the reports of the last day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftline.functions.text import gram_hashes, sim_norm
from siftline.operators.assignment import LEAST_BODY, SLOT_S, slot_end
from siftline.operators.events import CLOSE_S, QUIET_S, SPAN_S
from siftline.operators.similarity import BODY_CHARS, THRESHOLD

OUT = "band long, kind string, id long, event long, at long"


class Postings:
    """gram -> reports, for one micro-batch: the stored sets as one sorted array, and lists for what the batch adds."""

    def __init__(self, sets: dict[int, np.ndarray]):
        self.ids = list(sets)
        self.size = {i: len(s) for i, s in sets.items()}
        grams = np.concatenate(list(sets.values())) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(self.ids)), [len(s) for s in sets.values()]) if sets else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.added = grams[order], owner[order], {}

    def add(self, report: int, grams: np.ndarray) -> None:
        self.size[report] = len(grams)
        self.added[report] = grams

    def alike(self, grams: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(report, Jaccard) of all reports at the threshold or above."""
        if not len(grams):
            return []
        first, last = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        n = last - first
        where = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        same = np.bincount(self.owner[where], minlength=len(self.ids)) if len(self.ids) else np.zeros(0, np.int64)
        found = [(self.ids[k], int(same[k])) for k in np.flatnonzero(same)]
        found += [(i, int(np.isin(grams, g, assume_unique=True).sum())) for i, g in self.added.items()]
        return [(i, s / (len(grams) + self.size[i] - s)) for i, s in found if s and s / (len(grams) + self.size[i] - s) >= threshold]


class Assigner(StatefulProcessor):
    """Emits an `assigned` or `opened` row per report and a `quiet` or `closed` row per change of an event."""

    def __init__(self, threshold: float = THRESHOLD):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "event long", "first long, last long, quiet boolean")
        self.reports = handle.getMapState("reports", "id long", "event long, host string, article string, grams binary")
        self.due = handle.getValueState("due", "at long")

    def load(self) -> None:
        self.open = {k[0]: list(v) for k, v in self.events.iterator()}
        stored = {k[0]: v for k, v in self.reports.iterator()}
        self.of = {i: v[0] for i, v in stored.items()}
        self.host = {i: v[1] for i, v in stored.items()}
        self.article: dict[str, int] = {}  # article key -> its latest report
        for i, v in stored.items():
            if v[2]:
                self.article[v[2]] = max(i, self.article.get(v[2], i))
        self.index = Postings({i: np.frombuffer(v[3], np.int64) for i, v in stored.items() if v[3]})

    def drop(self, now: int) -> Iterator[tuple]:
        """Closes what is over at `now`, and says so; a report of a closed event is forgotten."""
        gone = {e for e, (first, last, _) in self.open.items() if last < now - CLOSE_S or first < now - SPAN_S}
        for e in sorted(gone):
            first, last, _ = self.open.pop(e)
            self.events.removeKey((e,))
            yield "closed", None, e, min(last + CLOSE_S, first + SPAN_S)
        if gone:
            for i in [i for i, e in self.of.items() if e in gone]:
                del self.of[i], self.host[i]
                self.reports.removeKey((i,))
        for e, (first, last, quiet) in sorted(self.open.items()):
            if not quiet and last < now - QUIET_S:
                self.open[e][2] = True
                self.events.updateValue((e,), (first, last, True))
                yield "quiet", None, e, last + QUIET_S

    def put(self, row: dict) -> tuple:
        grams = np.asarray(row["grams"] if row["grams"] is not None else [], np.int64)
        article = row["article"] or None
        same = self.article.get(article) if article else None
        found = self.of.get(same) if same is not None else None
        if found is None:
            alike = [(-s, i) for i, s in self.index.alike(grams, self.threshold) if i in self.of and self.host[i] != row["host"]]
            found = self.of[min(alike)[1]] if alike else None
        event = row["id"] if found is None else found
        first, last, _ = self.open.get(event, (row["ts"], row["ts"], False))
        self.open[event] = [first, max(last, row["ts"]), False]
        self.events.updateValue((event,), tuple(self.open[event]))
        self.of[row["id"]], self.host[row["id"]] = event, row["host"]
        if article:
            self.article[article] = row["id"]
        self.index.add(row["id"], grams)
        self.reports.updateValue((row["id"],), (event, row["host"], article, grams.tobytes()))
        return "opened" if found is None else "assigned", row["id"], event, row["ts"]

    def set_timer(self, mark: int) -> None:
        """One timer per band, at the next change of any of its events after the watermark."""
        changes = [t for first, last, quiet in self.open.values() for t in ([min(last + CLOSE_S, first + SPAN_S)] + ([] if quiet else [last + QUIET_S]))]
        old = self.due.get()[0] if self.due.exists() else None
        at = max(min(changes) + 1, mark // 1000 + 1) if changes else None
        if at != old:
            if old is not None:
                self.handle.deleteTimer(old * 1000)
            if at is None:
                self.due.clear()
            else:
                self.handle.registerTimer(at * 1000)
                self.due.update((at,))

    def frame(self, band: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            kind, ids, event, at = zip(*rows, strict=True)
            yield pd.DataFrame({"band": band, "kind": kind, "id": pd.array(ids, "Int64"), "event": event, "at": at})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        out = []
        every = pd.concat(list(rows)).sort_values(["now", "ts", "id"])
        for row in every.to_dict("records"):
            out += self.drop(row["now"])
            out.append(self.put(row))
        self.set_timer(timerValues.getCurrentWatermarkInMs())
        yield from self.frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        self.due.clear()
        out = list(self.drop(expiredTimerInfo.getExpiryTimeInMs() // 1000))
        self.set_timer(timerValues.getCurrentWatermarkInMs())
        yield from self.frame(key[0], out)

    def close(self) -> None:
        pass


def assign_stream(items: DataFrame, slot_s: int = SLOT_S, threshold: float = THRESHOLD, late: str = "10 minutes") -> DataFrame:
    """(band, kind, id, event, at) of a stream of items (id, band, ts in seconds, host, key, body, extract_status, n_chars).

    kind is opened or assigned for a report, quiet or closed for an event; a stream in order of ts gives what
    operators.assignment.assign_events gives within each band. Only extracted bodies of LEAST_BODY characters or more are compared,
    never two of one host. The session needs the RocksDB state store (see `state_settings`).
    """
    full = (F.col("extract_status") == "OK") & (F.col("n_chars") >= LEAST_BODY)
    grams = gram_hashes(sim_norm(F.substring(F.when(full, F.col("body")), 1, BODY_CHARS)))
    ready = items.select("id", "host", F.col("band").cast("long").alias("band"), F.col("ts").cast("long").alias("ts"), F.col("key").alias("article"), grams.alias("grams"), slot_end(F.col("ts"), slot_s).alias("now"), F.timestamp_seconds("ts").alias("event_time"))
    keyed = ready.withWatermark("event_time", late).groupBy("band")
    return keyed.transformWithStateInPandas(Assigner(threshold), OUT, "Append", "EventTime")


def state_settings() -> dict[str, str]:
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

"""Streaming: deduplication with retention, windows of counts, and the folds of operators.events with stored state.

A fold sees a key's rows of a micro-batch sorted by time and id, so a stream in order gives
what the batch form gives. State is the fold's own fields as JSON. With a retention, a key's state goes
when event time (the watermark) is past everything that the fold remembers, so a replay gives what the first run
gave; without one it stays, as in batch: a few numbers per key for life cycles and pacing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.operators import events as E

LATE = "1 hour"


def deduplicated(stream: DataFrame, key: str = "item_key", ts: str = "discovered_at", days: int = 21) -> DataFrame:
    """The first row of each key within the retention."""
    return stream.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def folded(stream: DataFrame, key: str, order: list[str], make: Callable, step: Callable[[object, dict], dict], schema: str, keep_s: int | None = None, late: str = LATE) -> DataFrame:
    """The streaming form of operators.events.ordered_fold; order[0] is the event time in seconds. keep_s: how long the fold itself remembers a row."""
    aged = keep_s is not None
    if aged:
        stream = stream.withColumn("event_time", F.timestamp_seconds(F.col(order[0]))).withWatermark("event_time", late)

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text, last = state.get if state.exists else (None, 0)
        fold = E.restored(make, text)
        rows = pd.concat(list(parts)).sort_values(order)
        out = [step(fold, r) for r in rows.to_dict("records")]
        last = max(last, int(rows[order[0]].max()))
        state.update((E.saved(fold), last))
        if aged:
            state.setTimeoutTimestamp(max((last + keep_s + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out)

    timeout = GroupStateTimeout.EventTimeTimeout if aged else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, schema, "saved string, last long", "append", timeout)


def lifecycle_stream(stream: DataFrame) -> DataFrame:
    """(id, key, event_no, member, reopened) for a stream of (id, key, ts)."""
    return folded(stream, "key", ["ts", "id"], E.Lifecycle, lambda s, r: {"id": r["id"], "key": r["key"], **s.step(r["ts"])}, "id long, key long, event_no int, member int, reopened boolean")


def pacing_stream(stream: DataFrame) -> DataFrame:
    return folded(stream, "key", ["ts", "id"], E.Pacing, lambda s, r: {"id": r["id"], "key": r["key"], **s.step(r["outcome"])}, "id long, key long, interval_s double, clean int")


def decision_stream(stream: DataFrame, desk: str = "desk", keep_s: int | None = None, late: str = LATE) -> DataFrame:
    """(id, target, status, reason, ref, update) for a stream of alert reports, in the order of its batches; see operators.events.decide."""
    out = folded(stream, desk, ["ts", "id"], lambda saved=None: E.Decisions(saved, keep_s), E.decision_step, E.DECIDED, keep_s, late)
    return out.withColumn("ref", F.col("ref").cast("long"))


def rolling_editions(stream: DataFrame, ts: str, section: str, late: str = "1 hour", step: str = "1 hour") -> DataFrame:
    """Stories per section of every rolling day (24 hours, each `step`)."""
    return counts_by_window_of(stream, ts, section, F.window(ts, "24 hours", step), late)


def daily_editions(stream: DataFrame, ts: str, section: str, offset: str = "18 hours 30 minutes", late: str = "1 hour") -> DataFrame:
    """Stories per section of every local day, which starts `offset` after midnight UTC (here: 5:30 ahead of it)."""
    return counts_by_window_of(stream, ts, section, F.window(ts, "24 hours", "24 hours", offset), late)


def counts_by_window_of(stream: DataFrame, ts: str, kind: str, window: Column, late: str) -> DataFrame:
    counted = stream.withWatermark(ts, late).groupBy(window.alias("window"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), kind, "n")

"""Event assignment and replay: which open event a report belongs to, and the states of events over time.

The joins do the heavy part: candidates are similar bodies (copies as one) and equal keys within
the longest life of an event. What depends on order is a small fold over each connected
group of candidates, whose state is the group's open events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.events import CLOSE_S, QUIET_S, SPAN_S, ordered_fold
from siftline.operators.graph import components
from siftline.operators.similarity import BODY_CHARS, THRESHOLD, gram_sets, set_pairs
from siftline.session import written

SLOT_S = 300
LEAST_BODY = 400
SWEEP_LEAST = 256


def slot_end(ts: Column, slot_s: int = SLOT_S) -> Column:
    """The end of the tick that a report comes in with, which is the clock of its batch."""
    return (F.ceil(ts / slot_s) * slot_s).cast("long")


class Assignment:
    """Reports of one connected group, in order of time: by key among open events (the latest report's), else by the most similar report of an open event and another host, else a new event.

    Reports with equal sets are members of one vertex, so a report knows what it is like by vertices, however many copies there are.
    """

    def __init__(self, saved: dict | None = None):
        self.events: dict[int, list[int]] = {}  # event -> first and last time
        self.of: dict[int, int] = {}  # report -> event
        self.keys: dict[str, list[int]] = {}  # key -> reports
        self.members: dict[int, dict[str, list[int]]] = {}  # vertex -> host -> reports
        self.kept = 0  # keys and vertices when those without an open report were last dropped
        self.__dict__.update(saved or {})

    def nearest(self, vertex: int, host: str) -> int | None:
        """The smallest report of a vertex that belongs to an open event and to another host."""
        self.tidy(vertex)
        return min((min(ids) for h, ids in self.members.get(vertex, {}).items() if h != host), default=None)

    def tidy(self, vertex: int) -> None:
        own = {h: live for h, ids in self.members.pop(vertex, {}).items() if (live := [i for i in ids if i in self.of])}
        if own:
            self.members[vertex] = own

    def sweep(self) -> None:
        """Drops keys and vertices without an open report, each time that there are twice as many as it left."""
        if len(self.keys) + len(self.members) <= 2 * max(self.kept, SWEEP_LEAST):
            return
        self.keys = {k: live for k, ids in self.keys.items() if (live := [i for i in ids if i in self.of])}
        for vertex in list(self.members):
            self.tidy(vertex)
        self.kept = len(self.keys) + len(self.members)

    def step(self, row: dict) -> dict:
        """row: id, ts, now, key (or None), host, vertex (or None), matches [(vertex, similarity)], its own at 1 among them."""
        now = row["now"]
        self.events = {e: t for e, t in self.events.items() if t[1] >= now - CLOSE_S and t[0] >= now - SPAN_S}
        self.of = {i: e for i, e in self.of.items() if e in self.events}
        self.sweep()
        same = [i for i in self.keys.get(row["key"], []) if i in self.of] if row["key"] else []
        alike = [] if same else [(-s, i) for v, s in row["matches"] if (i := self.nearest(v, row["host"])) is not None]
        found = self.of[max(same)] if same else self.of[min(alike)[1]] if alike else None
        event = row["id"] if found is None else found
        first, last = self.events.get(event, (row["ts"], row["ts"]))
        self.events[event] = [first, max(last, row["ts"])]
        self.of[row["id"]] = event
        if row["key"]:
            self.keys[row["key"]] = [*same, row["id"]]
        if row["vertex"] is not None:
            self.members.setdefault(row["vertex"], {}).setdefault(row["host"], []).append(row["id"])
        return {"id": row["id"], "event": event, "joined": found is not None}


def near_vertices(items: DataFrame, threshold: float = THRESHOLD, chars: int = BODY_CHARS) -> tuple[DataFrame, DataFrame]:
    """(id, vertex) of items with a body, and similar vertices (a, b, similarity) of one stretch of SPAN_S seconds or the next.

    A vertex is what one stretch has of one set: copies are compared once, and pairs are never of copies.
    """
    stretch = F.floor(F.col("ts") / SPAN_S)
    band = F.col("band") if "band" in items.columns else F.lit(0)
    sets = written(gram_sets(items.select("id", "host", "body", F.xxhash64(band, stretch).alias("band"), F.struct(band.alias("band"), stretch.alias("at")).alias("place")), "body", chars, keep=["place"], bits=False), "gram-sets")
    keyed = sets.select("id", "place", F.xxhash64("set").alias("hash"), F.size("set").alias("n"), "set")
    vertices = written(keyed.groupBy("place", "hash", "n").agg(F.min("id").alias("vertex"), F.any_value("set").alias("set")), "vertices")
    of = keyed.select("id", "place", "hash", "n").join(vertices.select("place", "hash", "n", "vertex"), ["place", "hash", "n"]).select("id", "vertex")
    both = vertices.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.col("vertex").alias("id"), F.lit("").alias("host"), F.xxhash64("place.band", F.col("place.at") + F.col("shift")).alias("band"), "set")
    return of, set_pairs(both, threshold, cross_host=False).distinct()


def assign_events(items: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """(id, event, joined) for items (id, ts in seconds, host, key, body, extract_status, n_chars); an event is named by its first report.

    Only extracted bodies of LEAST_BODY characters or more are compared, and never two of one host. Reports are linked with their vertex, vertices
    with similar ones, reports of a key with the first of their day's and that with the next day's: groups are cut where
    nothing happens for a day, since no event lives longer.
    """
    full = items.filter((F.col("extract_status") == "OK") & (F.col("n_chars") >= LEAST_BODY))
    of, pairs = near_vertices(full)
    of, pairs = written(of, "vertices-of"), written(pairs, "pairs")
    keyed = items.filter("key is not null and key <> ''").select("id", "key", F.floor(F.col("ts") / SPAN_S).alias("day"))
    first = written(keyed.groupBy("key", "day").agg(F.min("id").alias("first")), "keys")
    stars = keyed.join(first, ["key", "day"]).filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    next_day = first.join(first.select("key", (F.col("day") - 1).alias("day"), F.col("first").alias("after")), ["key", "day"]).select(F.col("first").alias("a"), F.col("after").alias("b"))
    groups = components(pairs.select("a", "b").union(of.filter("id <> vertex")).union(stars).union(next_day))
    sides = pairs.select("a", "b", "similarity").union(pairs.select("b", "a", "similarity")).toDF("vertex", "other", "similarity")
    own = of.select("vertex").distinct().select("vertex", F.col("vertex").alias("other"), F.lit(1.0).alias("similarity"))
    matches = sides.union(own).groupBy("vertex").agg(F.collect_list(F.struct("other", "similarity")).alias("matches"))
    rows = items.select("id", "ts", "key", "host").join(groups, "id", "left").join(of, "id", "left").join(matches, "vertex", "left")
    ready = rows.select("id", "ts", slot_end(F.col("ts"), slot_s).alias("now"), "key", "host", F.coalesce("component", "id").alias("group"), "vertex", "matches")

    def step(s: Assignment, r: dict) -> dict:
        matches = [] if r["matches"] is None else [(int(m["other"]), float(m["similarity"])) for m in r["matches"]]
        return s.step({**r, "matches": matches, "vertex": None if r["vertex"] != r["vertex"] else r["vertex"]})

    return ordered_fold(ready, "group", ["now", "ts", "id"], Assignment, step, "id long, event long, joined boolean")


def event_states(assigned: DataFrame, now: Column) -> DataFrame:
    """(event, members, first_ts, last_ts, status at `now`) of assigned rows (id, event, ts): CLOSED after 24 silent hours or 24 hours after the first report, QUIET after six silent ones."""
    each = assigned.groupBy("event").agg(F.count("*").alias("members"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    closed = (F.col("last_ts") < now - CLOSE_S) | (F.col("first_ts") < now - SPAN_S)
    return each.withColumn("status", F.when(closed, "CLOSED").when(F.col("last_ts") < now - QUIET_S, "QUIET").otherwise("OPEN"))


def replay(items: DataFrame, cutoff: Column, slot_s: int = SLOT_S) -> DataFrame:
    """What each tick of a virtual clock would have done: (slot, reports, opened, joined, alertable) over assigned items; reports before the cutoff never alert."""
    assigned = assign_events(items, slot_s).join(items.select("id", "ts", "urgent"), "id")
    each = assigned.withColumn("slot", slot_end(F.col("ts"), slot_s))
    return each.groupBy("slot").agg(F.count("*").alias("reports"), F.count_if(~F.col("joined")).alias("opened"), F.count_if("joined").alias("joined"), F.count_if(F.col("urgent") & (F.col("ts") >= cutoff)).alias("alertable"))

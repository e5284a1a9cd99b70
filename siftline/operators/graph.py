"""Connected components and ordered greedy representatives, by rounds of joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import written


FEW_LINKS = 100_000  # so many open links at most are settled on the driver


def reached(edges: pa.Table) -> pa.Table:
    """(id, component) of few edges (u, v), at once."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for u, v in zip(edges["u"].to_pylist(), edges["v"].to_pylist(), strict=True):
        a, b = top(u), top(v)
        up[max(a, b)] = min(a, b)
    return pa.table({"id": pa.array(list(up), pa.int64()), "component": pa.array([top(x) for x in list(up)], pa.int64())})


def components(edges: DataFrame, few_links: int = FEW_LINKS) -> DataFrame:
    """(id, component) for every id in edges (a, b): the smallest id that can be reached.

    Alternates two contractions: larger neighbours are pointed at a vertex's smallest
    neighbour, then smaller ones are. Every round is written to the shared folder.
    Rounds go on until nothing changes; once at most few_links links are left, the driver settles
    them at once, which spares it the jobs of the rounds.
    """
    star = written(edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        seen = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == before or not seen["n"]:
            break
        if seen["n"] <= few_links:
            return written(star.sparkSession.createDataFrame(reached(star.toArrow())), "components")
        before = seen
        both = star.union(star.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = written(small.union(own.select("u", F.col("m").alias("v"))).distinct(), "star")
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).union(star.select("v", "v").distinct())


def decide(rows: list) -> list[tuple[int, int]]:
    """(id, representative) of open rows, given each with every better row that it links to and what that is known to be."""
    links: dict[int, list] = {}
    rank, known = {}, {}
    for r in rows:
        own = links.setdefault(r["id"], [])
        if r["b"] is not None:
            own.append((r["rank_b"], r["b"]))
            rank[r["id"]], known[r["b"]] = r["rank_a"], r["of_b"]
    out: dict[int, int] = {i: i for i in links if i not in rank}  # nothing better
    for i in sorted(rank, key=lambda x: rank[x]):
        out[i] = min(((k, b) for k, b in links[i] if out.get(b, known[b]) == b), default=(None, i))[1]
    return list(out.items())


def spark_rows(like: DataFrame, rows: list[tuple]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, like.schema)


def greedy_representatives(ranked: DataFrame, edges: DataFrame, few_links: int = FEW_LINKS) -> DataFrame:
    """(id, representative): each row, best rank first, joins the first representative that it links to, else becomes one.

    ranked (id, rank) has distinct ranks, best lowest; edges (a, b) are symmetric links.
    A row is decided once every better row that it links to is: it is a representative
    if none of those is. All rows without open better neighbours are decided in one
    round, so rounds follow the longest chain of links and never chain a merge: a link
    to a row that isn't a representative counts for nothing. Rounds go on until every row is
    decided; once at most few_links links are open, the driver decides the rest in order of rank.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    better = both.join(ranked.select(F.col("id").alias("a"), F.col("rank").alias("rank_a")), "a").join(ranked.select(F.col("id").alias("b"), F.col("rank").alias("rank_b")), "b").filter("rank_b < rank_a")
    better = written(better.select("a", "b", "rank_a", "rank_b"), "links")
    linked = better.select(F.col("a").alias("id")).union(better.select("b")).distinct()
    state = written(linked.withColumn("representative", F.lit(None).cast("long")), "state")
    before = None
    while left := state.filter("representative is null").count():
        if left == before:  # the best open row is decided in every round
            raise RuntimeError(f"{left} rows stay undecided: ranks or links aren't as stated")
        before = left
        if left <= few_links:
            rest = state.filter("representative is null").select("id").join(better, F.col("id") == F.col("a"), "left").join(state.select(F.col("id").alias("b"), F.col("representative").alias("of_b")), "b", "left")
            rows = rest.select("id", "rank_a", "b", "rank_b", "of_b").limit(few_links + 1).collect()
            if len(rows) <= few_links:
                decided = spark_rows(state, decide(rows))
                state = written(state.filter("representative is not null").union(decided), "state")
                break
        seen = better.join(state.select(F.col("id").alias("b"), F.col("representative").alias("of_b")), "b")
        facts = seen.groupBy("a").agg(
            F.count_if(F.col("of_b").isNull()).alias("open"),
            F.min(F.when(F.col("of_b") == F.col("b"), F.struct("rank_b", "b"))).alias("first"),
            F.min(F.when(F.col("of_b").isNull(), F.col("rank_b"))).alias("open_rank"),
        )
        after = state.join(facts, F.col("id") == F.col("a"), "left")
        settled = F.col("first").isNotNull() & (F.col("open_rank").isNull() | (F.col("first.rank_b") < F.col("open_rank")))
        decided = F.when(settled, F.col("first.b")).when(F.coalesce("open", F.lit(0)) == 0, F.col("id"))
        state = written(after.select("id", F.coalesce("representative", decided).alias("representative")), "state")
    return ranked.select("id").join(state, "id", "left").select("id", F.coalesce("representative", "id").alias("representative"))

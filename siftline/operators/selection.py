"""Quota selection, top-k per group, stratified picks, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.session import written


def selection_order(columns: list[str] = ()) -> list[Column]:
    """Priority, urgent first, higher impact where there is one, higher score, older first, id."""
    impact = [F.desc(F.coalesce("impact", F.lit(0)))] if "impact" in columns else []
    return [F.coalesce("priority", F.lit(9)), F.desc("urgent"), *impact, F.desc("score"), F.asc("published"), F.asc("id")]


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= n)


def quota_select(df: DataFrame, per: int, total: int, uncapped: list[str] = ()) -> DataFrame:
    """Chosen rows with `pass`: forced (manual, or of an uncapped category), head (the first per category among
    priorities 1 and 2), fill (the best of the rest up to total; forced and head rows always stay).

    The head keeps `per` rows a category in every partition before it is shuffled, and the fill is a
    global top-k of what the head left, so no category and no table is sorted whole.
    """
    marked = df.withColumn("forced", F.coalesce(F.col("manual") | F.col("category").isin(list(uncapped)), F.lit(False)))
    rest = marked.filter("not forced")
    head = top_per_group(rest.filter("priority <= 2"), "category", selection_order(df.columns), per).drop("rank")
    head = written(head, "head")
    forced = marked.filter("forced").withColumn("pass", F.lit("forced"))
    room = max(0, total - head.count() - marked.filter("forced").count())
    others = rest.join(head.select("id"), "id", "left_anti").select(rest.columns)
    fill = others.orderBy(*selection_order(df.columns)).limit(room).withColumn("pass", F.lit("fill"))
    return forced.unionByName(head.withColumn("pass", F.lit("head"))).unionByName(fill).drop("forced")


def one_card_per_story(df: DataFrame) -> DataFrame:
    """Of the rows of a category with one story key (those with an @ name a cluster) the best stays, with the ids of all in `merged`."""
    clustered = F.contains(F.coalesce("story", F.lit("")), F.lit("@"))
    order = selection_order(df.columns)
    place = F.row_number().over(W.partitionBy("category", "story").orderBy(*order))
    rows = df.filter(clustered).withColumn("place", place)
    ids = rows.groupBy("category", "story").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("merged"))
    first = rows.filter("place = 1").drop("place").join(ids, ["category", "story"]).select(*df.columns, "merged")
    return first.unionByName(df.filter(~clustered).withColumn("merged", F.array("id")).select(*df.columns, "merged"))


def urgent_block(chosen: DataFrame, categories: list[str]) -> DataFrame:
    """With `block`: urgent for urgent rows of priority 1 in one of the categories, else the category."""
    first = (F.col("priority") == 1) & F.col("category").isin(categories) & F.coalesce("urgent", F.lit(False))
    return chosen.withColumn("block", F.when(first, "urgent").otherwise(F.col("category")))


def stratified(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Round robin over the groups: every group's first row, then every second one, up to n rows; with `turn`."""
    ranked = df.withColumn("turn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("turn") <= n)
    return ranked.orderBy("turn", key).limit(n)


def first_per_group_first(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """One row of every group before any second one, in the given order; with `later`. No group has more than n rows among them, so that many of each are kept before the shuffle."""
    ranked = top_per_group(df, key, order, n, "turn")
    return ranked.withColumn("later", F.col("turn") > 1).drop("turn").orderBy("later", *order).limit(n)


def numbered_batches(df: DataFrame, group: str, order: list[Column], size: int, weight: Column | None = None) -> DataFrame:
    """(k/n) part numbers per group: batch of each row and batches in all. With a weight (1 or more), batches hold so much of it instead of rows.

    Rows are dealt by ranges of group and order, so a large group is spread; a small table of the ranges'
    counts says how many rows of the group come before each range.
    """
    ranged = written(df.repartitionByRange(group, *order).withColumn("b_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(group, "b_part").agg((F.count("*") if weight is None else F.sum(weight)).alias("b_n"))
    rows = W.partitionBy(group)
    before = F.coalesce(F.sum("b_n").over(rows.orderBy("b_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(F.col(group).alias("b_group"), F.col("b_part").alias("b_at"), before.alias("b_before"), F.sum("b_n").over(rows).alias("b_all"))
    within = W.partitionBy(group, "b_part").orderBy(*order)
    own = F.row_number().over(within) if weight is None else F.sum(weight).over(within.rowsBetween(W.unboundedPreceding, 0))
    named = ranged.withColumn("b_own", own).join(placed, F.col(group).eqNullSafe(F.col("b_group")) & (F.col("b_part") == F.col("b_at")))
    return named.withColumns({"batch": F.floor((F.col("b_before") + F.col("b_own") - 1) / size) + 1, "batches": F.ceil(F.col("b_all") / size)}).select(*df.columns, "batch", "batches")

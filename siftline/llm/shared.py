"""Shared folder of the cluster: written intermediate tables that survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.session import drop as drop
from siftline.session import shared_dir
from siftline.session import written as stage


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def might_be_in(docs: DataFrame, ids: DataFrame, bits: int | None = None) -> DataFrame:
    """Rows of docs whose doc_id is in ids (column id), and a few others: a one-hash Bloom filter before a shuffle.

    The filter has eight bits or more per id, so about an eighth of the other rows pass at most.
    It goes to every task, as a table of MOST_BITS/64 words at most; for more ids than that
    holds (17 million) there is no filter, and the exact join behind it shuffles all rows.
    """
    if bits is None:
        n = ids.count()
        bits = max(LEAST_BITS, 1 << max(0, 8 * n - 1).bit_length())
        if bits > MOST_BITS:
            return docs
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (slot(c) % 64).cast("int"))
    words = ids.groupBy(F.floor(slot("id") / 64).alias("f_word")).agg(F.bit_or(bit("id")).alias("f_bits"))
    return docs.join(F.broadcast(words), F.floor(slot("doc_id") / 64) == F.col("f_word")).filter(F.col("f_bits").bitwiseAND(bit("doc_id")) != 0).select(docs.columns)


def top_rows(df: DataFrame, value: str, most: int, key: str) -> DataFrame:
    """The `most` rows with the largest positive values, or all if there are fewer; equal ones by a hash of key, whose values are distinct.

    Three histograms of at most a few thousand rows each narrow the border down: by the value's
    logarithm, by the value within that step, by the hash among equal values. So no task and
    not the driver sorts more than what is kept.
    """
    rows = df.filter(F.col(value) > 0)
    log = F.floor(F.log2(F.col(value).cast("double")) * 32)
    place = F.pmod(F.xxhash64(key, F.lit("top")), F.lit(1 << 40))
    keep, border, left = F.lit(False), F.lit(True), most

    def narrow(step: Column) -> bool:
        """Keeps whole steps from the top while they fit; the next one is the new border. True if everything fits."""
        nonlocal keep, border, left
        histogram = rows.filter(border).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
        for row in sorted(histogram, key=lambda r: -r["step"]):
            if row["n"] > left:
                keep, border = keep | border & (step > row["step"]), border & (step == row["step"])
                return False
            left -= row["n"]
        keep = keep | border
        return True

    if not narrow(log):
        edge = rows.filter(border).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
        done, lo, hi = False, edge["lo"], edge["hi"]
        while not done and hi > lo:  # each turn looks at a 4096th of the values' range, until they are equal
            width = (hi - lo) / 4096
            done = narrow(F.least(F.floor((F.col(value).cast("double") - lo) / width), F.lit(4095)))
            if not done:
                edge = rows.filter(border).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
                if (edge["lo"], edge["hi"]) == (lo, hi):
                    break
                lo, hi = edge["lo"], edge["hi"]
        shift = 28
        while not done and shift >= 0:  # equal values: 12 bits of the hash a turn
            done = narrow(F.floor(place / (1 << shift)) % 4096)
            shift -= 12
    return rows.filter(keep)


def places(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df with `place`: 1, 2, 3 and so on in each group, by order; without group columns, in the whole table.

    Rows are dealt by ranges of group and order and written with their running numbers, so a
    group of any size spreads over many tasks. The ranges' first numbers and counts, at most a row per
    group and range, say how many of a group's rows come before.
    """
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    kept = stage(ranged.withColumns({"p_part": F.spark_partition_id(), "p_id": F.monotonically_increasing_id()}), name)
    parts = kept.groupBy(*(F.col(g).alias(f"p_{g}") for g in group), F.col("p_part").alias("p_at")).agg(F.min("p_id").alias("p_first"), F.count("*").alias("p_n"))
    rows = Window.partitionBy(*(f"p_{g}" for g in group)).orderBy("p_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*(f"p_{g}" for g in group), "p_at", "p_first", F.coalesce(F.sum("p_n").over(rows), F.lit(0)).alias("p_before"))
    on = F.col("p_part") == F.col("p_at")
    for g in group:
        on = F.col(g).eqNullSafe(F.col(f"p_{g}")) & on
    placed = kept.join(starts if group else F.broadcast(starts), on)  # without a group: one row per range
    return placed.withColumn("place", F.col("p_id") - F.col("p_first") + F.col("p_before") + 1).select(*df.columns, "place")

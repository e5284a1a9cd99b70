"""Tables of a data folder, and the engine's inputs made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THIN_CHARS = 400


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def extract_status(n_chars: Column) -> Column:
    """OK from 400 characters, THIN from 1, else FAILED."""
    return F.when(n_chars >= THIN_CHARS, "OK").when(n_chars > 0, "THIN").otherwise("FAILED")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """documents as news items: the first line is the title, the source the host."""
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("body"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("host"),
        F.col("lang").alias("language"), "n_chars", extract_status(F.col("n_chars")).alias("extract_status"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """events with an instant (UTC) instead of a zone-less timestamp."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """orders as ranked candidates of the customer's segment."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("category"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_totalprice").alias("score"), F.col("o_orderdate").cast("timestamp").alias("published"), (F.col("o_orderstatus") == "F").alias("urgent"), (F.pmod("o_orderkey", F.lit(97)) == 0).alias("manual"),
    )

"""Edition, index, archive and export sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTIMENTS = ["neutral", "negative", "positive"]


def edition_index(stories: DataFrame, edition: str, category: str, sentiment: str) -> DataFrame:
    """Counts by edition and category, in all and by sentiment."""
    return stories.groupBy(edition, category).agg(F.count("*").alias("n"), *(F.count_if(F.col(sentiment) == s).alias(s) for s in SENTIMENTS))


def edition_documents(stories: DataFrame, key: str, rank: str) -> DataFrame:
    """(key, document): one JSON object per edition, its stories in order of rank. An edition is bounded by its quotas."""
    rest = [c for c in stories.columns if c not in (key, rank)]
    each = stories.groupBy(key).agg(F.count("*").alias("items"), F.array_sort(F.collect_list(F.struct(rank, *rest))).alias("stories"))
    return each.select(key, F.to_json(F.struct(F.col(key).alias("key"), "items", "stories")).alias("document"))


def write_editions(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").partitionBy(documents.columns[0]).text(path) if len(documents.columns) == 2 else documents.write.mode("overwrite").json(path)


def write_archive(items: DataFrame, shown: DataFrame, day: Column, path: str) -> None:
    """Items by day without bodies, each with whether it was shown."""
    flagged = items.drop("body").join(shown.select("id").distinct().withColumn("shown", F.lit(True)), "id", "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    flagged.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(path)


def archive_turn(day: Column, today: Column) -> Column:
    """When a day's archive is written: first two days later, finally 15 days later; null in between and before."""
    age = F.datediff(today, day)
    return F.when(age >= 15, "final").when(age >= 2, "first")


def archive_due(days: DataFrame, written: DataFrame, today: Column) -> DataFrame:
    """Days whose archive must be written now, with the turn; written (day, turn) are those that were."""
    asked = days.withColumn("turn", archive_turn(F.col("day"), today)).filter("turn is not null")
    final = written.filter("turn = 'final'").select("day")
    return asked.join(final, "day", "left_anti").join(written.select("day", "turn"), ["day", "turn"], "left_anti")


def export_csv(df: DataFrame, path: str) -> None:
    """A labelled table for spreadsheets: header, UTF-8 with a byte order mark in the first name."""
    first, *rest = df.columns
    df.select(F.col(first).alias(f"﻿{first}"), *rest).write.mode("overwrite").option("header", True).csv(path)


def same_signature(a: DataFrame, b: DataFrame) -> bool:
    """Whether two editions show a reader the same, in any order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def publish_if_changed(edition: DataFrame, path: str) -> bool:
    """Writes an edition only if what is at path differs; says whether it wrote."""
    spark = edition.sparkSession
    try:
        old = spark.read.schema(edition.schema).parquet(path)
        if same_signature(edition, old):
            return False
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    edition.write.mode("overwrite").parquet(path)
    return True

"""Sheets as inputs: vocabulary, settings, channels, links log, feedback; each validated, problems kept as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.matching import TIERS
from siftline.functions.urls import channel_id

ROLES = ["include", "exclude", "urgent"]
CATEGORY_WORDS = ["mention", "constituency", "district", "portfolio", "political", "opportunity"]
SENTIMENT_WORDS = ["positive", "negative", "neutral"]


def read_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, its names in any case and order; missing columns are null; with the line's number."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.strip().lower().lstrip("﻿"): c for c in raw.columns}
    named = raw.select(*(F.col(f"`{have[c]}`").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns))
    return named.withColumn("line", F.monotonically_increasing_id())


def looks_like_html(text: Column) -> Column:
    """A sheet's address sometimes answers with a page."""
    return F.contains(F.lower(F.substring(text, 1, 500)), F.lit("<html"))


def vocabulary(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, problems): inactive rows go silently; tiers, roles, weights and places' roles are checked; the first of equal (tier, term, role) stays."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = raw.filter(~F.lower(text("active")).isin("no", "n", "false", "0")).select("line", F.lower(text("tier")).alias("tier"), F.lower(text("term")).alias("term"), text("language").alias("language"), text("weight").alias("weight_text"), F.lower(text("group")).alias("group"), F.when(text("role") == "", "include").otherwise(F.lower(text("role"))).alias("role"))
    weight = F.expr("try_cast(weight_text as int)")
    default = F.element_at(F.create_map(*(x for k, v in TIERS.items() for x in (F.lit(k), F.lit(v)))), F.col("tier"))
    problem = (
        F.when(~F.col("tier").isin(list(TIERS)), "unknown tier")
        .when(F.col("term") == "", "empty term")
        .when(~F.col("role").isin(ROLES), "unknown role")
        .when((F.col("role") == "urgent") & ~F.col("tier").isin("civic", "crime"), "urgent outside civic and crime")
        .when((F.col("weight_text") != "") & weight.isNull(), "weight is not a number")
    )
    judged = rows.withColumn("problem", problem)
    first = F.row_number().over(W.partitionBy("tier", "term", "role").orderBy("line"))
    kept = judged.filter("problem is null").withColumn("k", first)
    good = kept.filter("k = 1").select("line", "tier", "term", "language", F.coalesce(weight, default).alias("weight"), F.when(F.col("group") == "", F.col("term")).otherwise(F.col("group")).alias("group"), "role")
    bad = judged.filter("problem is not null").select("line", "problem").union(kept.filter("k > 1").select("line", F.lit("duplicate")))
    return good, bad


def vocabulary_usable(good: DataFrame) -> DataFrame:
    """One row: whether there is a place that isn't an exclusion, and an urgent term."""
    return good.agg(F.coalesce(F.bool_or(F.col("tier").isin("constituency", "district") & (F.col("role") != "exclude")), F.lit(False)).alias("places"), F.coalesce(F.bool_or(F.col("role") == "urgent"), F.lit(False)).alias("urgent")).withColumn("usable", F.col("places") & F.col("urgent"))


def settings(sheet: DataFrame, defaults: DataFrame, allowed: list[str]) -> DataFrame:
    """Allowed keys of the sheet over the defaults; a key that was removed from the sheet falls back."""
    asked = sheet.select(F.trim("key").alias("key"), F.trim("value").alias("value")).filter(F.col("key").isin(allowed) & (F.col("value") != "")).groupBy("key").agg(F.max("value").alias("sheet_value"))
    return defaults.join(asked, "key", "full_outer").select("key", F.coalesce("sheet_value", "value").alias("value"))


def channels(sheet: DataFrame, known: DataFrame, interval_s: int = 180) -> tuple[DataFrame, DataFrame]:
    """(channels, problems): valid ids once, attributes of known channels kept, default interval."""
    rows = sheet.select("line", F.trim("name").alias("name"), channel_id(F.col("channel_id")).alias("channel"), F.lower(F.trim(F.coalesce("enabled", F.lit("yes")))).alias("enabled"), F.expr("try_cast(poll_interval_s as int)").alias("interval"))
    first = F.row_number().over(W.partitionBy("channel").orderBy("line"))
    good = rows.filter("channel is not null").withColumn("k", first).filter("k = 1")
    out = good.join(known.select("channel", F.col("name").alias("known_name"), F.col("poll_interval_s").alias("known_interval")), "channel", "left")
    return (
        out.select("channel", F.coalesce(F.nullif("name", F.lit("")), "known_name", "channel").alias("name"), (~F.col("enabled").isin("no", "false", "0")).alias("enabled"), F.coalesce("interval", "known_interval", F.lit(interval_s)).alias("poll_interval_s")),
        rows.filter("channel is null").select("line", F.lit("no channel id").alias("problem")),
    )


def parse_links(df: DataFrame, text: str) -> DataFrame:
    """Every url or item:N of free text, in order, with the category and sentiment words that follow it before the next one.

    The text is split before each link, so the words between links belong to the link before them.
    """
    parts = F.filter(F.split(F.col(text), r"(?=https?://|\bitem:\d)"), lambda p: p.rlike(r"^(?:https?://|item:\d)"))
    rows = df.select("*", F.posexplode(parts).alias("place", "part"))
    word = lambda words: F.nullif(F.lower(F.regexp_extract("part", rf"(?i)(?:^|[\s#,;])({'|'.join(words)})\b", 1)), F.lit(""))
    return rows.withColumns({"link": F.regexp_extract("part", r"^(https?://[^\s,;]+|item:\d+)", 1), "category": word(CATEGORY_WORDS), "sentiment": word(SENTIMENT_WORDS)}).drop("part")


HIDE_WORDS, RESTORE_WORDS = ["hidden", "hide", "remove"], ["restore", "show", "unhide"]
FEEDBACK_TYPES, NOTE_CHARS = ["wrong", "missing", "praise", "move", "hide"], 500


def links_sheet(raw: DataFrame) -> DataFrame:
    """Rows of the links sheet in order: (line, ref, category, sentiment, kind). raw: line, link, category, sentiment, note.

    ref is the first address of the cell without closing marks, else `item:` and the story's number from the cell or, in rows
    that the page wrote itself (kind move, by their note), from the note; rows without either go.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    own = F.lower(text("note")).startswith("on-page")
    address = F.regexp_replace(F.regexp_extract(text("link"), r"(https?://\S+)", 1), r"[.;)|,]+$", "")
    number = F.coalesce(F.nullif(F.regexp_extract(text("link"), r"(?:item:|#)(\d{1,12})", 1), F.lit("")), F.when(own, F.nullif(F.regexp_extract(text("note"), r"on-page \w+ #(\d{1,12})", 1), F.lit(""))))
    ref = F.coalesce(F.nullif(address, F.lit("")), F.concat(F.lit("item:"), number))
    asked = F.lower(text("category"))
    category = F.when(asked.isin(HIDE_WORDS), "hidden").when(asked.isin(RESTORE_WORDS), "restore").when(asked.isin(CATEGORY_WORDS), asked)
    mood = F.lower(text("sentiment"))
    return raw.select("line", ref.alias("ref"), category.alias("category"), F.when(mood.isin(SENTIMENT_WORDS), mood).alias("sentiment"), F.when(own, "move").otherwise("sheet").alias("kind")).filter("ref is not null")


def accepted_feedback(posts: DataFrame, token: str) -> DataFrame:
    """Posts (type, note, token, ts) that may be appended: a known type and the right token; notes cut to NOTE_CHARS."""
    kind = F.lower(F.trim("type"))
    return posts.filter(kind.isin(FEEDBACK_TYPES) & (F.col("token") == token)).select(kind.alias("type"), F.substring(F.coalesce("note", F.lit("")), 1, NOTE_CHARS).alias("note"), "ts")


def feedback_counts(feedback: DataFrame, now) -> DataFrame:
    """Feedback by type: all, and of the last seven days."""
    return feedback.groupBy("type").agg(F.count("*").alias("all"), F.count_if(F.col("when") >= now - F.make_interval(days=F.lit(7))).alias("week"))

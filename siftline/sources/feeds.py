"""Feed entries, video listings and polls as rows; the network stays outside (payloads land as files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.urls import item_key

THUMBNAIL = T.StructType([T.StructField("url", T.StringType())])
VIDEO_PAGE = T.StructType([T.StructField("items", T.ArrayType(T.StructType([
    T.StructField("snippet", T.StructType([
        T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("publishedAt", T.StringType()), T.StructField("channelTitle", T.StringType()),
        T.StructField("resourceId", T.StructType([T.StructField("videoId", T.StringType())])),
        T.StructField("thumbnails", T.StructType([T.StructField(k, THUMBNAIL) for k in ("medium", "high", "default")])),
    ])),
])))])


def published(*raw: Column) -> Column:
    """The first date that can be read; zone-less ones are UTC; null if none can."""
    formats = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z"]
    day_off = lambda r: F.regexp_replace(F.trim(r), r"^[A-Za-z]{3,9},\s*", "")
    return F.coalesce(*(F.try_to_timestamp(day_off(r), F.lit(f)) for r in raw for f in formats))


def entries(raw: DataFrame) -> DataFrame:
    """Parsed feed entries (link, title, summary, description, content, publisher, published, updated) to item rows."""
    text = lambda *names: F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))
    return raw.select("*", item_key(F.col("link")).alias("item_key"), text("summary", "description", "content").alias("body"), published(F.col("published"), F.col("updated")).alias("published_at"))


def video_entries(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Video API pages (JSON text) to entries; pages that can't be read give none."""
    s = F.col("item.snippet")
    rows = pages.select("*", F.explode(F.from_json(payload, VIDEO_PAGE)["items"]).alias("item")).filter(s["resourceId"]["videoId"].isNotNull())
    return rows.select(
        F.concat(F.lit("https://www.youtube.com/watch?v="), s["resourceId"]["videoId"]).alias("link"), s["title"].alias("title"), s["description"].alias("summary"), s["channelTitle"].alias("publisher"), published(s["publishedAt"]).alias("published_at"),
        F.coalesce(*(s["thumbnails"][k]["url"] for k in ("medium", "high", "default"))).alias("image"),
    )


def new_items(found: DataFrame, known: DataFrame, order: list[Column]) -> DataFrame:
    """First writer wins: rows whose item_key isn't known yet, one per key."""
    first = F.row_number().over(W.partitionBy("item_key").orderBy(*order))
    return found.join(known.select("item_key"), "item_key", "left_anti").withColumn("k", first).filter("k = 1").drop("k")


def poll_log(found: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per source: entries and new ones."""
    return found.groupBy("source_id").agg(F.count("*").alias("entries")).join(fresh.groupBy("source_id").agg(F.count("*").alias("new")), "source_id", "left").na.fill(0, ["new"])


def poll_rows(polls: DataFrame, entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """One log row per poll (poll_id, source_id, ts, status, error), also unchanged and failed ones, with its entries and new ones; errors cut to 500 characters.

    entries and fresh have poll_id.
    """
    count = lambda df, name: df.groupBy("poll_id").agg(F.count("*").alias(name))
    told = polls.join(count(entries, "entries"), "poll_id", "left").join(count(fresh, "new"), "poll_id", "left").na.fill(0, ["entries", "new"])
    return told.withColumns({"not_modified": F.col("status") == 304, "error": F.substring("error", 1, 500)})


def feed_url(kind: Column, value: Column, language: Column, search: str = "https://news.example/rss/search", videos: str = "https://www.youtube.com/feeds/videos.xml") -> Column:
    """A source's feed address by kind: an address as it is, a search with its language, a video channel."""
    query = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    found = F.concat(F.lit(f"{search}?q="), query, F.lit("&hl="), language)
    return F.when(kind == "search", found).when(kind == "channel", F.concat(F.lit(f"{videos}?channel_id="), value)).when(kind == "rss", value)


def resolved_status(blocked: Column, encoded: Column, resolved: Column, attempts: Column, most: int = 4) -> Column:
    """What becomes of a link: SKIPPED where it is no token, BLOCKED before any attempt, RESOLVED, FAILED after the last attempt, else PENDING."""
    return F.when(~encoded, "SKIPPED").when(blocked, "BLOCKED").when(resolved.isNotNull(), "RESOLVED").when(attempts >= most, "FAILED").otherwise("PENDING")


def extracted_status(host: Column, http: Column, chars: Column, video_hosts: list[str], social_hosts: list[str]) -> Column:
    """Skips by host, failures by HTTP status, then by length."""
    listed = lambda hosts: F.coalesce(F.greatest(*(((host == h) | F.endswith(host, F.lit(f".{h}"))).cast("int") for h in hosts), F.lit(0)) == 1, F.lit(False))
    return F.when(listed(video_hosts), "SKIPPED_VIDEO").when(listed(social_hosts), "SKIPPED_SOCIAL").when(http >= 400, "FAILED").when(chars >= 400, "OK").when(chars > 0, "THIN").otherwise("FAILED")


def ready(items: DataFrame, now: Column, most: int = 300) -> DataFrame:
    """Items to score: fetched or given up, oldest discovery first."""
    return items.filter(F.col("band").isNull() & ((F.col("extract_status") != "PENDING") | F.col("resolve_status").isin("FAILED", "BLOCKED")) & (F.col("discovered_at") <= now)).orderBy("discovered_at", "id").limit(most)


def outlet(publisher: Column, source: Column, host: Column) -> Column:
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(known(publisher), known(source), known(host), F.lit("?"))


def read_items(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landing files as a stream of items."""
    return spark.readStream.schema(schema).json(path)

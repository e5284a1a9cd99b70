"""Queries of the source helpers: keys, ids, dates, addresses, logs, archives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import urls
from siftline.operators import reports as R
from siftline.operators.stories import image
from siftline.session import shared_dir
from siftline.sources import feed_source, feeds, sinks
from siftline.sources.adapters import events, table


def item_keys(spark: SparkSession, d: str) -> DataFrame:
    """Feed token, video id or hash of an address, in turn."""
    n = F.col("page_id")
    token = F.concat(F.lit("https://news.example/rss/articles/"), F.md5("url"), F.lit("?oc=5"))
    video = F.concat(F.lit("https://youtu.be/"), F.substring(F.md5("url"), 1, 11))
    link = F.when(n % 3 == 0, token).when(n % 3 == 1, video).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", urls.item_key(link).alias("key"))


def video_ids(spark: SparkSession, d: str) -> DataFrame:
    code, n = F.substring(F.md5("url"), 1, 11), F.col("page_id")
    forms = [F.concat(F.lit(a), code, F.lit(b)) for a, b in (("https://www.youtube.com/watch?t=1&v=", "&x=2"), ("https://youtu.be/", "?t=3"), ("https://m.youtube.com/shorts/", ""), ("https://www.youtube.com/embed/", "/"), ("https://notyoutube.com/watch?v=", ""))]
    return table(spark, d, "pages").select("page_id", urls.video_id(F.element_at(F.array(*forms), (n % 5 + 1).cast("int"))).alias("video"))


def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Instants through the date forms of feeds and back; broken ones fall to the second date."""
    ts, n = F.col("ts"), F.col("event_id")
    rfc = F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    iso = F.date_format(ts, "yyyy-MM-dd\'T\'HH:mm:ss\'Z\'")
    first = F.when(n % 3 == 0, rfc).when(n % 3 == 1, iso).otherwise("soon")
    return events(spark, d).select("event_id", F.unix_seconds(feeds.published(first, F.when(n % 2 == 0, iso))).alias("s"))


def poll_rows(spark: SparkSession, d: str) -> DataFrame:
    """events as polls: views are unchanged (304), errors fail, purchases bring entries, half of them new."""
    e = table(spark, d, "events").withColumn("poll_id", F.col("event_id"))
    status = F.when(F.col("event_type") == "view", 304).when(F.col("event_type") == "error", 500).otherwise(200)
    polls = e.select("poll_id", F.col("user_id").alias("source_id"), status.alias("status"), F.when(F.col("event_type") == "error", F.repeat("props", 60)).alias("error"))
    entries = e.filter("event_type = 'purchase'").select("poll_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("place"))
    rows = feeds.poll_rows(polls, entries, entries.filter("place % 2 = 0"))
    return rows.groupBy("source_id").agg(F.count("*").alias("polls"), F.count_if("not_modified").alias("unchanged"), F.sum("entries").alias("entries"), F.sum("new").alias("new"), F.max(F.length("error")).alias("longest_error"))


def landed_feeds(spark: SparkSession, d: str) -> str:
    """pages as feed documents of ten entries, RSS and Atom in turn, from three sources; every fifth poll is asked again and answers with the same ETag, every seventh fails. Returns their folder."""
    n, poll = F.col("page_id"), F.floor(F.col("page_id") / 10).cast("long")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = safe(F.concat(F.lit("Page "), n.cast("string"), F.lit(" & <more>")))
    ts = F.timestamp_seconds(n * 3600)
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), safe(F.col("url")), F.lit("</link><pubDate>"), F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><source url='x'>Paper</source></item>"))
    atom = F.concat(F.lit('<entry><title>'), title, F.lit('</title><link rel="self" href="other"/><link href="'), safe(F.col("url")), F.lit('"/><published>'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published></entry>"))
    each = table(spark, d, "pages").select(poll.alias("poll"), F.struct(n.alias("n"), F.when(poll % 2 == 0, rss).otherwise(atom).alias("x")).alias("e"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["x"]), "")  # ten entries a document
    docs = each.groupBy("poll").agg(inner.alias("inner"))
    body = F.when(F.col("poll") % 2 == 0, F.concat(F.lit("<rss><channel><title>T</title>"), F.col("inner"), F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title>'), F.col("inner"), F.lit("</feed>")))
    failed = F.col("poll") % 7 == 6
    first = docs.select((F.col("poll") * 600).alias("polled_at"), F.concat(F.lit("s~"), (F.col("poll") % 3).cast("string")).alias("source_id"), F.when(failed, 500).otherwise(200).alias("status"), F.when(~failed, F.concat(F.lit('W/"'), F.col("poll").cast("string"), F.lit('"'))).alias("etag"), body.alias("body"))
    again = first.filter("polled_at % 3000 = 0 and status = 200").withColumn("polled_at", F.col("polled_at") + 30)
    path = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    feed_source.land(first.union(again), path)
    return path


def entry_rows(df: DataFrame) -> DataFrame:
    at = F.unix_seconds(feeds.published(F.col("published"), F.col("updated")))
    return df.select("source_id", "polled_at", "status", "not_modified", "place", "link", "title", "publisher", at.alias("published_s"))


def feed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Polls and entries read from landed feed documents."""
    spark.dataSource.register(feed_source.FeedDocuments)
    return entry_rows(spark.read.format("feed_documents").load(landed_feeds(spark, d)))


def feed_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same through a stream that ends when it has read all."""
    spark.dataSource.register(feed_source.FeedDocuments)
    base = f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}"
    stream = spark.readStream.format("feed_documents").load(landed_feeds(spark, d))
    entry_rows(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows")


FEED_SQL = """WITH p AS (SELECT page_id, url, page_id // 10 AS poll FROM pages), q AS (SELECT DISTINCT poll FROM p),
  r AS (SELECT poll, poll * 600 AS polled_at, CASE WHEN poll % 7 = 6 THEN 500 ELSE 200 END AS status, false AS same FROM q UNION ALL SELECT poll, poll * 600 + 30, 200, true FROM q WHERE poll % 5 = 0 AND poll % 7 <> 6)
  SELECT 's~' || poll % 3 AS source_id, polled_at, status, same AS not_modified, NULL::INTEGER AS place, NULL AS link, NULL AS title, NULL AS publisher, NULL::BIGINT AS published_s FROM r
  UNION ALL SELECT 's~' || poll % 3, poll * 600, 200, false, (row_number() OVER (PARTITION BY poll ORDER BY page_id) - 1)::INTEGER, url, 'Page ' || page_id || ' & <more>', CASE WHEN poll % 2 = 0 THEN 'Paper' END, page_id * 3600 FROM p WHERE poll % 7 <> 6"""


def feed_urls(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(x) for x in ("search", "channel", "rss"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", feeds.feed_url(kind, F.col("p_name"), F.lit("en")).alias("url"))


def outlet_names(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda m, c: F.when(F.col("c_custkey") % m == 0, "  ").otherwise(F.col(c))
    named = feeds.outlet(blank(2, "c_name"), blank(3, "c_mktsegment"), F.when(F.col("c_custkey") % 5 != 0, F.lit("host")))
    return table(spark, d, "customer").select("c_custkey", named.alias("outlet"))


def thumbnails(spark: SparkSession, d: str) -> DataFrame:
    """The stored picture, else the payload's medium, high or default one."""
    n = F.col("p_partkey")
    pic = lambda k, m: F.when(n % m == 0, F.concat(F.lit(f'"{k}": {{"url": "{k}'), n.cast("string"), F.lit('"}')))
    payload = F.concat(F.lit('{"thumbnails": {'), F.concat_ws(", ", pic("medium", 3), pic("high", 5), pic("default", 7)), F.lit("}}"))
    return table(spark, d, "part").select("p_partkey", image(F.when(n % 11 == 0, F.lit("own")).otherwise(""), payload).alias("image"))


def archive_due(spark: SparkSession, d: str) -> DataFrame:
    """Days of orders whose archive is due on the 20th of January 1998."""
    days = table(spark, d, "orders").filter("o_orderdate >= '1997-12-01'").select(F.to_date("o_orderdate").alias("day")).distinct()
    done = days.filter("dayofmonth(day) % 4 = 0").withColumn("turn", F.when(F.dayofmonth("day") % 8 == 0, "final").otherwise("first"))
    due = sinks.archive_due(days.filter("day <= '1998-01-20'"), done, F.lit("1998-01-20").cast("date"))
    return due.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "turn")


def spoken_ages(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(R.ago(F.lit(1_706_659_200) - F.unix_seconds("ts")).alias("age")).agg(F.count("*").alias("n"))


PLANS = {
    "item_keys": (item_keys, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN md5(url) WHEN 1 THEN substr(md5(url), 1, 11) ELSE 'u:' || substr(sha256(url), 1, 32) END AS key FROM pages"),
    "video_ids": (video_ids, "SELECT page_id, CASE WHEN page_id % 5 < 4 THEN substr(md5(url), 1, 11) END AS video FROM pages"),
    "parsed_dates": (parsed_dates, "SELECT event_id, CASE WHEN event_id % 3 < 2 OR event_id % 2 = 0 THEN epoch_us(ts) // 1000000 END AS s FROM events"),
    "poll_rows": (poll_rows, """SELECT user_id AS source_id, count(*) AS polls, count(*) FILTER (event_type = 'view') AS unchanged, (4 * count(*) FILTER (event_type = 'purchase'))::BIGINT AS entries, (2 * count(*) FILTER (event_type = 'purchase'))::BIGINT AS new,
        max(least(500, 60 * length(props))) FILTER (event_type = 'error')::INTEGER AS longest_error FROM events GROUP BY 1"""),
    "feed_documents": (feed_documents, FEED_SQL),
    "feed_stream": (feed_stream, FEED_SQL),
    "feed_urls": (feed_urls, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://news.example/rss/search?q=' || url_encode(p_name) || '&hl=en' WHEN 1 THEN 'https://www.youtube.com/feeds/videos.xml?channel_id=' || p_name ELSE p_name END AS url FROM part"),
    "outlet_names": (outlet_names, "SELECT c_custkey, CASE WHEN c_custkey % 2 <> 0 THEN c_name WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 5 <> 0 THEN 'host' ELSE '?' END AS outlet FROM customer"),
    "thumbnails": (thumbnails, "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'own' WHEN p_partkey % 3 = 0 THEN 'medium' || p_partkey WHEN p_partkey % 5 = 0 THEN 'high' || p_partkey WHEN p_partkey % 7 = 0 THEN 'default' || p_partkey END AS image FROM part"),
    "archive_due": (archive_due, """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_orderdate >= '1997-12-01' AND o_orderdate <= '1998-01-20'), t AS (SELECT day, CASE WHEN DATE '1998-01-20' - day >= 15 THEN 'final' WHEN DATE '1998-01-20' - day >= 2 THEN 'first' END AS turn, day(day) AS n FROM d)
        SELECT day::VARCHAR AS day, turn FROM t WHERE turn IS NOT NULL AND n % 8 <> 0 AND NOT (n % 4 = 0 AND turn = 'first')"""),
    "spoken_ages": (spoken_ages, "WITH a AS (SELECT 1706659200 - epoch_us(ts) // 1000000 AS s FROM events) SELECT CASE WHEN s < 7200 THEN floor(s / 60)::BIGINT || ' min' WHEN s < 172800 THEN floor(s / 3600)::BIGINT || ' h' ELSE floor(s / 86400)::BIGINT || ' d' END AS age, count(*) AS n FROM a GROUP BY 1"),
}

"""Operational, evaluation and publication queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.operators import reports as R
from siftline.sources.adapters import candidates, events, extract_status, items, table

KINDS = ["view", "click", "signup", "purchase", "error"]
text_day = lambda c: F.date_format(c, "yyyy-MM-dd")
text_hour = lambda c: F.date_format(c, "yyyy-MM-dd HH:00")
LOCAL = "(ts + INTERVAL '5 hours 30 minutes')"
END_TS = "2024-02-01 00:00:00"


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.counts(table(spark, d, "documents"), "source").orderBy(F.desc("n"), "source")


def extraction_health(spark: SparkSession, d: str) -> DataFrame:
    return R.extraction_health(items(spark, d), "host").drop("thin_lengths")


def items_per_hour(spark: SparkSession, d: str) -> DataFrame:
    return R.hourly_histogram(events(spark, d), "ts").withColumn("hour", text_hour(F.col("hour")))


def error_profile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id", F.substring("props", 1, 40).alias("prefix")).agg(F.count("*").alias("n"))


def status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return R.share_of_total(table(spark, d, "orders"), "o_orderstatus")


def ok_rate_by_host(spark: SparkSession, d: str) -> DataFrame:
    return R.ok_rate(table(spark, d, "events"), "user_id", F.col("event_type") != "error")


def poll_gaps(spark: SparkSession, d: str) -> DataFrame:
    return R.gaps(events(spark, d), "user_id", "ts", 15)


def due_sources(spark: SparkSession, d: str) -> DataFrame:
    last = events(spark, d).groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return R.due(last, "user_id", "last_ts", now, 6 * 3600).select("user_id", F.unix_seconds("last_ts").alias("last_s"))


def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Days from order to shipment per priority: nearest-rank median and 90 %, and how many took over 60."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    days = o.join(li, o.o_orderkey == li.l_orderkey).select("o_orderpriority", F.datediff("l_shipdate", "o_orderdate").alias("days"))
    p50 = R.nearest_rank_by(days, ["o_orderpriority"], "days", 0.5, "p50")
    p90 = R.nearest_rank_by(days, ["o_orderpriority"], "days", 0.9, "p90")
    late = days.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("days") > 60).alias("late"))
    return late.join(p50, "o_orderpriority").join(p90, "o_orderpriority")


def age_profile(spark: SparkSession, d: str) -> DataFrame:
    """Whole days of age per event type: rows, upper median, largest, part of at most two days."""
    aged = events(spark, d).withColumn("age", F.floor((F.unix_seconds(F.lit(END_TS).cast("timestamp")) - F.unix_seconds("ts")) / 86400))
    median = R.upper_median_by(aged, ["event_type"], "age", "upper_median")
    rest = aged.groupBy("event_type").agg(F.count("*").alias("n"), F.max("age").alias("oldest"), F.round(100.0 * F.count_if(F.col("age") <= 2) / F.count("*"), 4).alias("fresh_percent"))
    return rest.join(median, "event_type")


def per_day_outcome_pivot(spark: SparkSession, d: str) -> DataFrame:
    return R.day_pivot(events(spark, d), "ts", "event_type", KINDS).withColumn("day", text_day(F.col("day")))


def category_sentiment_cube(spark: SparkSession, d: str) -> DataFrame:
    return R.cross_tab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


def day_section_matrix(spark: SparkSession, d: str) -> DataFrame:
    return R.day_matrix(events(spark, d), "ts", "event_type", 7).withColumn("day", text_day(F.col("day")))


def first_poll_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Events that fall on the same user's first day."""
    e = events(spark, d)
    first = e.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first_day"), F.min_by("event_id", "ts").alias("first_event"))
    return e.join(first, "user_id").groupBy("user_id", "first_event").agg(F.count_if(F.to_date("ts") == F.col("first_day")).alias("on_first_day"), F.count("*").alias("n"))


def visit_stats(spark: SparkSession, d: str) -> DataFrame:
    """Views, visitors and bots (here: signups) per local day; days without a visit count."""
    rows = events(spark, d).filter("event_type in ('view', 'signup')").withColumn("visitor", F.sha2(F.concat_ws("|", F.lit("salt"), "user_id"), 256))
    return R.visit_stats(rows, "ts", "visitor", F.col("event_type") == "signup").withColumn("day", text_day(F.col("day")))


def retention_trim(spark: SparkSession, d: str) -> DataFrame:
    return R.retained(events(spark, d), "ts", "event_id", F.lit(END_TS).cast("timestamp"), 15, 500).select("event_id", "event_type")


def stale_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Events that come over six hours after the user's previous one."""
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    lag = F.unix_micros("ts") - F.unix_micros(before)
    return events(spark, d).withColumn("lag_us", lag).filter(F.col("lag_us") > 6 * 3600 * 1_000_000).select("event_id", "user_id")


def quota_day_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(text_day(R.quota_day(F.col("ts"))).alias("day")).agg(F.count("*").alias("n"))


def slot_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(R.slot(F.col("ts")).alias("slot"), "event_type").agg(F.count("*").alias("n"))


def month_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def dimension_left_join(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def semi_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


def not_exists_silent(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders, but none since 1998."""
    o = table(spark, d, "orders")
    late = o.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def label_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("length", F.col("n_chars").cast("double"))
    return R.threshold_scores(both, "length", F.col("quality") == 1, [200.0, 400.0, 800.0, 1600.0])


def band_precision(spark: SparkSession, d: str) -> DataFrame:
    """Quality per band of text length."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    band = F.when(F.col("n_chars") < 400, "a <400").when(F.col("n_chars") < 1200, "b <1200").when(F.col("n_chars") < 4000, "c <4000").otherwise("d rest")
    return both.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("precision"))


def category_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rows, pass rate and toxic rate per language of the labelled rows; languages with 20 rows or more."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("pass_rate"), F.round(F.avg(F.col("toxic").cast("double")), 6).alias("toxic_rate"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("both")).filter("n >= 20 and pass_rate > 0.1")


def archive_flags(spark: SparkSession, d: str) -> DataFrame:
    """Documents with whether they are shown: themselves, or as a part of a merged one (here the next id)."""
    docs = table(spark, d, "documents")
    shown = docs.filter("doc_id % 10 = 0").select(F.explode(F.array("doc_id", F.col("doc_id") + 1)).alias("doc_id")).distinct().withColumn("hit", F.lit(True))
    return docs.join(shown, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("shown"))


def incremental_log(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each conversation after the two that were seen; of one in five, more were seen than there are."""
    log = table(spark, d, "conversations").select("conv_id", "turn", "role")
    seen = log.select("conv_id").distinct().withColumn("seen", F.when(F.col("conv_id") % 5 == 0, 1000).otherwise(2))
    return R.beyond_seen(log, "conv_id", "turn", seen)


def override_fold(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_state(table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("role")), "conv_id", "turn", "role")


def status_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """One row: how many items there are, of which status, kept and dropped."""
    s = extract_status(F.col("n_chars"))
    return table(spark, d, "documents").agg(F.count("*").alias("items"), *(F.count_if(s == k).alias(k.lower()) for k in ("OK", "THIN", "FAILED")), F.countDistinct("source").alias("sources"))


def channels_without_entries(spark: SparkSession, d: str) -> DataFrame:
    """Users who were polled (click) on the last day but never had an entry (purchase) in it."""
    e = events(spark, d).filter(F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return e.filter("event_type = 'click'").select("user_id").distinct().join(e.filter("event_type = 'purchase'"), "user_id", "left_anti")


def term_contribution(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark by how many items hold them, and how many of those are even-numbered; the top 20."""
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term")).filter("term <> ''")
    return words.groupBy("term").agg(F.count("*").alias("n"), F.count_if(F.col("item_id") % 2 == 0).alias("even")).orderBy(F.desc("n"), "term").limit(20)


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A number out of JSON, grouped in tens; broken JSON would count as null."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy(F.floor(k / 10).cast("int").alias("tens")).agg(F.count("*").alias("n"))


def same_place_window(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with another purchase of the same user in the three hours before."""
    p = events(spark, d).filter("event_type = 'purchase'").select("event_id", "user_id", F.unix_micros("ts").alias("us"))
    before = F.count("*").over(W.partitionBy("user_id").orderBy("us").rangeBetween(-3 * 3600 * 1_000_000, -1))
    return p.withColumn("before", before).filter("before > 0").select("event_id", "before")


def probe_verdict(spark: SparkSession, d: str) -> DataFrame:
    """One row: success rate, median value and what to think of it."""
    e = table(spark, d, "events")
    return e.agg(F.count("*").alias("n"), F.round(F.count_if(F.col("event_type") != "error") / F.count("*"), 6).alias("ok_rate"), F.round(F.median("value"), 6).alias("median_value"), F.count_if(F.col("value") > 200).alias("slow")).withColumn("verdict", F.when(F.col("ok_rate") >= 0.9, "go").when(F.col("ok_rate") >= 0.7, "care").otherwise("stop"))


def relational_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of two key sets, as counts."""
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    n = lambda df, name: df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return n(a.union(b).distinct(), "union").union(n(a.intersect(b), "intersect")).union(n(a.exceptAll(b), "except"))


THRESHOLDS = "(SELECT unnest([200.0::DOUBLE, 400, 800, 1600]) AS threshold)"
PLANS = {
    "source_counts": (source_counts, "SELECT source, count(*) AS n FROM documents GROUP BY source"),
    "extraction_health": (extraction_health, """WITH s AS (SELECT source AS host, n_chars, CASE WHEN n_chars >= 400 THEN 'OK' WHEN n_chars > 0 THEN 'THIN' ELSE 'FAILED' END AS st FROM documents),
        e AS (SELECT host, count(*) AS n, count(*) FILTER (st = 'OK') AS ok, count(*) FILTER (st = 'THIN') AS thin, count(*) FILTER (st = 'FAILED') AS failed, count(DISTINCT n_chars) FILTER (st = 'THIN') AS tl FROM s GROUP BY host)
        SELECT host, n, ok, thin, failed, CASE WHEN ok = n THEN 'good' WHEN thin >= 2 AND tl = 1 THEN 'same stub every time' WHEN failed * 2 > n THEN 'mostly fails' ELSE 'mixed' END AS diagnosis FROM e"""),
    "items_per_hour": (items_per_hour, """WITH h AS (SELECT date_trunc('hour', ts) AS hr, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 18)
        SELECT strftime(hr, '%Y-%m-%d %H:00') AS hour, n, repeat('#', ceil(40.0::DOUBLE * n / max(n) OVER ())::INTEGER) AS bar FROM h"""),
    "error_profile": (error_profile, "SELECT user_id, substr(props, 1, 40) AS prefix, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL"),
    "status_distribution": (status_distribution, "SELECT o_orderstatus, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM orders GROUP BY 1"),
    "ok_rate_by_host": (ok_rate_by_host, "SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok, round(count(*) FILTER (event_type <> 'error')::DOUBLE / count(*), 6) AS ok_rate FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 15"),
    "poll_gaps": (poll_gaps, """WITH g AS (SELECT user_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts) AS gap_s FROM events)
        SELECT user_id, count(*) AS gaps, sum(gap_s)::BIGINT AS gap_seconds, max(gap_s)::BIGINT AS longest_s FROM g WHERE gap_s > 900 GROUP BY 1"""),
    "due_sources": (due_sources, "SELECT user_id, (epoch_us(max(ts)) // 1000000)::BIGINT AS last_s FROM events GROUP BY 1 HAVING epoch_us(TIMESTAMP '2024-01-30 12:00:00') // 1000000 - epoch_us(max(ts)) // 1000000 >= 21600"),
    "latency_quantiles": (latency_quantiles, """WITH x AS (SELECT o_orderpriority, datediff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
        r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY days) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM x)
        SELECT o_orderpriority, count(*) AS n, count(*) FILTER (days > 60) AS late, (max(days) FILTER (k = floor(0.5::DOUBLE * (c - 1) + 0.5) + 1))::INTEGER AS p50, (max(days) FILTER (k = floor(0.9::DOUBLE * (c - 1) + 0.5) + 1))::INTEGER AS p90 FROM r GROUP BY 1"""),
    "age_profile": (age_profile, f"""WITH x AS (SELECT event_type, (epoch_us(TIMESTAMP '{END_TS}') // 1000000 - epoch_us(ts) // 1000000) // 86400 AS age FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY age) AS k, count(*) OVER (PARTITION BY event_type) AS c FROM x)
        SELECT event_type, count(*) AS n, max(age)::BIGINT AS oldest, round(100.0::DOUBLE * count(*) FILTER (age <= 2) / count(*), 4) AS fresh_percent, (max(age) FILTER (k = c // 2 + 1))::BIGINT AS upper_median FROM r GROUP BY 1"""),
    "per_day_outcome_pivot": (per_day_outcome_pivot, f"SELECT strftime({LOCAL}, '%Y-%m-%d') AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1"),
    "category_sentiment_cube": (category_sentiment_cube, "SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS row_name, CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS column_name, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)"),
    "day_section_matrix": (day_section_matrix, f"""WITH x AS (SELECT {LOCAL}::DATE AS day, event_type FROM events), y AS (SELECT * FROM x WHERE day > (SELECT max(day) FROM x) - 7)
        SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN grouping(event_type) = 1 THEN 'All' ELSE event_type END AS section_name, count(*) AS n FROM y GROUP BY ROLLUP (day, event_type) HAVING day IS NOT NULL"""),
    "first_poll_overlap": (first_poll_overlap, """WITH f AS (SELECT user_id, min(ts)::DATE AS first_day, min_by(event_id, ts) AS first_event FROM events GROUP BY 1)
        SELECT user_id, first_event, count(*) FILTER (ts::DATE = first_day) AS on_first_day, count(*) AS n FROM events JOIN f USING (user_id) GROUP BY 1, 2"""),
    "visit_stats": (visit_stats, f"""WITH x AS (SELECT {LOCAL}::DATE AS day, user_id, event_type = 'signup' AS bot FROM events WHERE event_type IN ('view', 'signup')),
        e AS (SELECT day, count(*) FILTER (NOT bot) AS views, count(DISTINCT user_id) FILTER (NOT bot) AS visitors, count(*) FILTER (bot) AS bots FROM x GROUP BY 1),
        c AS (SELECT unnest(generate_series((SELECT min(day) FROM e)::TIMESTAMP, (SELECT max(day) FROM e)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day)
        SELECT strftime(c.day, '%Y-%m-%d') AS day, coalesce(views, 0) AS views, coalesce(visitors, 0) AS visitors, coalesce(bots, 0) AS bots FROM c LEFT JOIN e USING (day)"""),
    "retention_trim": (retention_trim, f"SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '{END_TS}' - INTERVAL 15 DAY ORDER BY ts DESC, event_id DESC LIMIT 500"),
    "stale_suppression": (stale_suppression, "WITH l AS (SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag_us FROM events) SELECT event_id, user_id FROM l WHERE lag_us > 21600000000"),
    "quota_day_counts": (quota_day_counts, "SELECT strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1"),
    "slot_counts": (slot_counts, f"SELECT CASE WHEN hour({LOCAL}) < 12 THEN 'morning' ELSE 'evening' END AS slot, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "month_groups": (month_groups, "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "dimension_left_join": (dimension_left_join, "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    "semi_labels": (semi_labels, "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "not_exists_silent": (not_exists_silent, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')"),
    "label_precision_recall": (label_precision_recall, f"""WITH b AS (SELECT n_chars, quality = 1 AS good FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT threshold, count(*) FILTER (n_chars >= threshold AND good) AS tp, count(*) FILTER (n_chars >= threshold AND NOT good) AS fp, count(*) FILTER (n_chars < threshold AND good) AS fn FROM b, {THRESHOLDS} GROUP BY 1)
        SELECT threshold, tp, fp, fn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall FROM c"""),
    "band_precision": (band_precision, """SELECT CASE WHEN n_chars < 400 THEN 'a <400' WHEN n_chars < 1200 THEN 'b <1200' WHEN n_chars < 4000 THEN 'c <4000' ELSE 'd rest' END AS band, count(*) AS n, count(*) FILTER (quality = 1) AS good, round(avg(quality::DOUBLE), 6) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY 1"""),
    "category_rates": (category_rates, """SELECT lang, count(*) AS n, round(avg(quality::DOUBLE), 6) AS pass_rate, round(avg(toxic::DOUBLE), 6) AS toxic_rate, count(*) FILTER (quality = 1 AND toxic = 1) AS "both" FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 20 AND round(avg(quality::DOUBLE), 6) > 0.1"""),
    "archive_flags": (archive_flags, "SELECT doc_id, doc_id IN (SELECT unnest([doc_id, doc_id + 1]) FROM documents WHERE doc_id % 10 = 0) AS shown FROM documents"),
    "incremental_log": (incremental_log, """WITH p AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS c, CASE WHEN conv_id % 5 = 0 THEN 1000 ELSE 2 END AS seen FROM conversations)
        SELECT conv_id, turn, role FROM p WHERE k > CASE WHEN c < seen THEN 0 ELSE seen END"""),
    "override_fold": (override_fold, "WITH o AS (SELECT conv_id, turn, max(role) AS role FROM conversations GROUP BY ALL) SELECT conv_id, max_by(role, turn) AS state, max(turn) AS seq, count(*) AS entries FROM o GROUP BY 1"),
    "status_snapshot": (status_snapshot, "SELECT count(*) AS items, count(*) FILTER (n_chars >= 400) AS ok, count(*) FILTER (n_chars > 0 AND n_chars < 400) AS thin, count(*) FILTER (n_chars <= 0) AS failed, count(DISTINCT source) AS sources FROM documents"),
    "channels_without_entries": (channels_without_entries, "WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-30') SELECT DISTINCT user_id FROM e WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM e WHERE event_type = 'purchase')"),
    "term_contribution": (term_contribution, r"""WITH w AS (SELECT item_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}]+'))) AS term FROM benchmark) SELECT term, count(*) AS n, count(*) FILTER (item_id % 2 = 0) AS even FROM w WHERE term <> '' GROUP BY 1 ORDER BY n DESC, term LIMIT 20"""),
    "json_props": (json_props, "SELECT (json_extract_string(props, '$.k')::INTEGER // 10)::INTEGER AS tens, count(*) AS n FROM events GROUP BY 1"),
    "same_place_window": (same_place_window, """WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 10800000000 PRECEDING AND 1 PRECEDING) AS before FROM p) SELECT event_id, before FROM b WHERE before > 0"""),
    "probe_verdict": (probe_verdict, """WITH e AS (SELECT count(*) AS n, round(count(*) FILTER (event_type <> 'error')::DOUBLE / count(*), 6) AS ok_rate, round(median(value), 6) AS median_value, count(*) FILTER (value > 200) AS slow FROM events) SELECT *, CASE WHEN ok_rate >= 0.9 THEN 'go' WHEN ok_rate >= 0.7 THEN 'care' ELSE 'stop' END AS verdict FROM e"""),
    "relational_sets": (relational_sets, """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
        SELECT 'union' AS kind, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""),
}

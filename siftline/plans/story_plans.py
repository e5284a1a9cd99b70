"""Event assignment, candidates, manual changes, hiding and delivery queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import assignment as A
from siftline.operators import candidates as C
from siftline.operators import events as E
from siftline.operators import reports as R
from siftline.operators import similarity
from siftline.functions.text import norm_title, places
from siftline.functions.urls import host
from siftline.plans.text_plans import MATCH_NORM, SIM_NORM
from siftline.sources.adapters import events, extract_status, table

START = 1_700_000_000  # seconds, of the invented clock: one document every 15 minutes
END = START + 900 * 1000
BANDS = ["AUTO_KEEP", "AI", "KEYWORD_KEEP", "DROP", "DROP"]


def stories(spark: SparkSession, d: str) -> DataFrame:
    """documents as scored, dated stories; every column follows from the row."""
    n = F.col("doc_id")
    ts = n * 900 + START
    text = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "documents").select(
        n.alias("id"), ts.alias("ts"), F.col("source").alias("host"), F.col("text").alias("body"), F.substring_index("text", "\n", 1).alias("title"), "n_chars", extract_status(F.col("n_chars")).alias("extract_status"),
        F.when(n % 7 == 0, F.concat(F.lit("k"), F.floor(n / 40).cast("string"))).alias("key"), F.element_at(F.array(*(F.lit(b) for b in BANDS)), (n % 5 + 1).cast("int")).alias("band"), (n % 17 == 0).alias("urgent"),
        F.when(n % 23 == 0, text(ts)).otherwise("").alias("manual_at"), F.when(n % 11 != 0, text(ts - (n % 13) * 7200)).alias("published_at"), text(ts).alias("discovered_at"), F.when(n % 19 != 0, text(ts + 60)).alias("rules_at"),
        (n % 6).cast("int").alias("priority"), (n % 9).cast("int").alias("score"), F.when(n % 2 == 0, F.lit("x")).alias("image_url"), (F.when(n % 29 == 0, 404).otherwise(200)).alias("http_status"), F.col("lang").alias("language"),
    )


STORIES = f"""st AS (SELECT doc_id AS id, doc_id * 900 + {START} AS ts, source AS host, text AS body, n_chars, CASE WHEN n_chars >= 400 THEN 'OK' WHEN n_chars > 0 THEN 'THIN' ELSE 'FAILED' END AS extract_status,
  CASE WHEN doc_id % 7 = 0 THEN 'k' || (doc_id // 40) END AS key, ['AUTO_KEEP', 'AI', 'KEYWORD_KEEP', 'DROP', 'DROP'][doc_id % 5 + 1] AS band, doc_id % 17 = 0 AS urgent,
  CASE WHEN doc_id % 23 = 0 THEN strftime(make_timestamp((doc_id * 900 + {START}) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END AS manual_at, CASE WHEN doc_id % 11 <> 0 THEN strftime(make_timestamp((doc_id * 900 + {START} - doc_id % 13 * 7200) * 1000000), '%Y-%m-%d %H:%M:%S') END AS published_at,
  strftime(make_timestamp((doc_id * 900 + {START}) * 1000000), '%Y-%m-%d %H:%M:%S') AS discovered_at, CASE WHEN doc_id % 19 <> 0 THEN strftime(make_timestamp((doc_id * 900 + {START} + 60) * 1000000), '%Y-%m-%d %H:%M:%S') END AS rules_at,
  (doc_id % 6)::INTEGER AS priority, (doc_id % 9)::INTEGER AS score, CASE WHEN doc_id % 2 = 0 THEN 'x' END AS image_url, CASE WHEN doc_id % 29 = 0 THEN 404 ELSE 200 END AS http_status, lang AS language, split_part(text, chr(10), 1) AS title FROM documents)"""
SINCE, PUBLISHED_SINCE = "2023-11-18 00:00:00", "2023-11-17 12:00:00"


def assigned(spark: SparkSession, d: str) -> DataFrame:
    """Urgent or kept stories go to events."""
    rows = stories(spark, d).filter(C.kept() | F.col("urgent")).withColumn("band", F.lit(0))
    return A.assign_events(rows)


def event_assign(spark: SparkSession, d: str) -> DataFrame:
    return assigned(spark, d)


def event_states(spark: SparkSession, d: str) -> DataFrame:
    """Events with their state at noon of the invented clock's third day."""
    rows = assigned(spark, d).join(stories(spark, d).select("id", "ts"), "id")
    return A.event_states(rows.filter(F.col("ts") <= START + 216_000), F.lit(START + 216_000))


def replay_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = stories(spark, d).filter(C.kept() | F.col("urgent")).withColumn("band", F.lit(0))
    return A.replay(rows, F.lit(START + 90_000), slot_s=7200)


def _assign_sql(slot: int) -> str:
    """One step a report: events' first and last times as lists, and the event of each report so far."""
    return f"""{STORIES}, o AS (SELECT *, row_number() OVER (ORDER BY ceil(ts / {slot}), ts, id) AS k, (ceil(ts / {slot}) * {slot})::BIGINT AS now FROM st WHERE band <> 'DROP' OR urgent),
i AS (SELECT k, {SIM_NORM.format('substr(body, 1, 1200)')} AS s, host, ts FROM o WHERE extract_status = 'OK' AND n_chars >= 400),
g AS (SELECT k, host, ts, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1)), lambda p: substr(s, p, 4))) AS gs FROM i), u AS (SELECT k, host, ts, len(gs) AS n, unnest(gs) AS gram FROM g),
p AS (SELECT a.k AS a, b.k AS b, count(*)::DOUBLE / (a.n + b.n - count(*)) AS sim FROM u a JOIN u b ON a.gram = b.gram AND a.k > b.k AND a.host <> b.host AND a.ts - b.ts <= 86400 GROUP BY a.k, b.k, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.45),
m AS (SELECT a AS k, list(b ORDER BY sim DESC, b) AS alike FROM p GROUP BY a), y AS (SELECT a.k, list(b.k ORDER BY b.id DESC) AS same FROM o a JOIN o b ON a.key = b.key AND b.k < a.k GROUP BY a.k),
q AS MATERIALIZED (SELECT o.k, o.id, o.ts, o.now, coalesce(alike, []) AS alike, coalesce(same, []) AS same FROM o LEFT JOIN m ON o.k = m.k LEFT JOIN y ON o.k = y.k),
f(k, id, ev, joined, of_k, firsts, lasts, names) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, false, []::BIGINT[], []::BIGINT[], []::BIGINT[], []::BIGINT[]
  UNION ALL SELECT k, id, names2[e], hit IS NOT NULL, list_append(of_k, e), CASE WHEN hit IS NULL THEN list_append(firsts, ts) ELSE firsts END, CASE WHEN hit IS NULL THEN list_append(lasts, ts) ELSE list_concat(list_concat(lasts[:e - 1], [greatest(lasts[e], ts)]), lasts[e + 1:]) END, names2
  FROM (SELECT *, coalesce(hit, len(firsts) + 1) AS e, CASE WHEN hit IS NULL THEN list_append(names, id) ELSE names END AS names2 FROM (
    SELECT q.k, q.id, q.ts, f.of_k, f.firsts, f.lasts, f.names, coalesce(
      of_k[list_filter(same, lambda j: lasts[of_k[j]] >= now - 86400 AND firsts[of_k[j]] >= now - 86400)[1]],
      of_k[list_filter(alike, lambda j: lasts[of_k[j]] >= now - 86400 AND firsts[of_k[j]] >= now - 86400)[1]]) AS hit FROM f JOIN q ON q.k = f.k + 1)))"""


ASSIGN_SQL = f"WITH RECURSIVE {_assign_sql(300)} SELECT id, ev AS event, joined FROM f WHERE k > 0"
STATES_SQL = f"""WITH RECURSIVE {_assign_sql(300)}, a AS (SELECT ev AS event, count(*) AS members, min(id * 900 + {START}) AS first_ts, max(id * 900 + {START}) AS last_ts FROM f WHERE k > 0 AND id * 900 <= 216000 GROUP BY ev)
SELECT *, CASE WHEN last_ts < {START + 216_000} - 86400 OR first_ts < {START + 216_000} - 86400 THEN 'CLOSED' WHEN last_ts < {START + 216_000} - 21600 THEN 'QUIET' ELSE 'OPEN' END AS status FROM a"""
REPLAY_SQL = f"""WITH RECURSIVE {_assign_sql(7200)} SELECT (ceil((id * 900 + {START}) / 7200) * 7200)::BIGINT AS slot, count(*) AS reports, count(*) FILTER (NOT joined) AS opened, count(*) FILTER (joined) AS joined, count(*) FILTER (id % 17 = 0 AND id * 900 >= 90000) AS alertable FROM f WHERE k > 0 GROUP BY 1"""


def candidate_scope(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with an upper bound as the scope."""
    scope = F.col("discovered_at") < F.lit("2023-11-24 00:00:00")
    return C.candidates(stories(spark, d), F.lit(SINCE), F.lit(PUBLISHED_SINCE), scope).select("id", "effective_at")


def best_first_order(spark: SparkSession, d: str) -> DataFrame:
    rows = stories(spark, d).withColumn("detail", F.when(F.col("extract_status").isin("OK", "THIN"), F.length("body")).otherwise(0))
    return rows.orderBy(*C.best_first()).limit(60).select("id", "priority", "detail")


def resolver_queue(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "PENDING").otherwise("RESOLVED").alias("status"), F.pmod("user_id", F.lit(6)).alias("attempts"))
    return C.newest_first(e, 4, 200).select("id", "attempts")


def top_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = stories(spark, d).filter("extract_status = 'OK'").withColumn("band", F.xxhash64("language"))
    return similarity.similar_pairs(rows).orderBy(F.desc("similarity"), "a", "b").limit(25).select("a", "b", F.round("similarity", 6).alias("similarity"))


def section_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*(F.lit(x) for x in ["added", "political", "odd", "mention", "district"])), (F.col("o_custkey") % 5 + 1).cast("int")).alias("category"))
    return C.sections_in_order(rows).groupBy("category", "section_place").agg(F.count("*").alias("n")).orderBy("section_place")


ASKED = ["constituency", "hide", "restore", "district", None]


def manual_log(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as hand-made changes of a story."""
    t = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("n"))
    asked = F.element_at(F.array(*(F.lit(x) for x in ASKED)), ((F.col("n") + F.col("turn")) % 5 + 1).cast("int"))
    return t.select(F.col("conv_id").alias("key"), F.col("turn").cast("long").alias("seq"), (F.col("conv_id") * 100 + F.col("turn")).alias("ts"), asked.alias("asked"), F.when(F.col("n") % 3 == 0, "negative").when(F.col("n") % 3 == 1, "positive").alias("sentiment"), (F.col("conv_id") % 2 == 0).alias("known"), (F.col("conv_id") % 6 == 1).alias("by_id"))


def manual_changes(spark: SparkSession, d: str) -> DataFrame:
    return C.manual_fold(manual_log(spark, d), ["constituency", "district"])


MANUAL_SQL = """WITH RECURSIVE t AS (SELECT conv_id, turn, max(length(text)) AS n FROM conversations GROUP BY 1, 2),
l AS (SELECT conv_id AS key, turn::BIGINT AS seq, conv_id * 100 + turn AS ts, ['constituency', 'hide', 'restore', 'district', NULL][(n + turn) % 5 + 1] AS asked, CASE n % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END AS sentiment, conv_id % 2 = 0 AS known, conv_id % 6 = 1 AS by_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t),
f(key, k, seq, outcome, handed, hidden, category, under, sentiment, manual_at) AS (SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, false, false, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT FROM l
  UNION ALL SELECT key, k, seq, o, o <> 'unknown' AND true OR handed, CASE o WHEN 'hidden' THEN true WHEN 'restored' THEN false ELSE hidden END,
    CASE o WHEN 'hidden' THEN 'hidden' WHEN 'restored' THEN coalesce(sec, under) WHEN 'unknown' THEN category WHEN 'already' THEN category ELSE coalesce(sec, category) END,
    CASE WHEN o = 'unknown' THEN under WHEN sec IS NOT NULL THEN sec ELSE under END, CASE WHEN o IN ('unknown', 'hidden', 'already') THEN CASE WHEN o = 'already' AND asked IS DISTINCT FROM 'hide' THEN coalesce(said, sentiment) ELSE sentiment END ELSE coalesce(said, sentiment) END, CASE WHEN o IN ('added', 'kept') THEN coalesce(manual_at, ts) ELSE manual_at END
  FROM (SELECT l.key, l.k, l.seq, l.ts, l.asked, l.sentiment AS said, f.handed, f.hidden, f.category, f.under, f.sentiment, f.manual_at, CASE WHEN asked IN ('constituency', 'district') THEN asked END AS sec,
    CASE WHEN by_id AND NOT known THEN 'unknown' WHEN handed AND asked = 'hide' AND NOT hidden THEN 'hidden' WHEN handed AND hidden AND asked IN ('constituency', 'district', 'restore') THEN 'restored'
      WHEN handed AND NOT hidden AND asked IS DISTINCT FROM 'hide' AND (asked IN ('constituency', 'district') AND asked IS DISTINCT FROM under OR l.sentiment IS NOT NULL AND l.sentiment IS DISTINCT FROM f.sentiment) THEN 'updated'
      WHEN handed THEN 'already' WHEN asked = 'hide' THEN 'hidden' WHEN known THEN 'kept' ELSE 'added' END AS o FROM f JOIN l ON l.key = f.key AND l.k = f.k + 1))
SELECT key, seq, outcome, category, sentiment, hidden, manual_at FROM f WHERE k > 0"""


def scrub_editions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stories of their month's edition, merged with the next order; every 40th is hidden."""
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("edition"), F.struct(F.col("o_orderkey").alias("id"), F.array("o_orderkey", F.col("o_orderkey") + 1).alias("merged"), (F.col("o_custkey") % 2 == 0).alias("shown")).alias("story"))
    editions = o.groupBy("edition").agg(F.array_sort(F.collect_list("story")).alias("stories"))
    hidden = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).filter("id % 40 = 0")
    return C.scrub_hidden(editions, hidden).select("edition", "left", "shown", "changed", F.array_min(F.transform("stories", lambda s: s["id"])).alias("first_id"))


def client_hides(spark: SparkSession, d: str) -> DataFrame:
    """What a reader still sees: errors hide the story of the event's number for 72 hours."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(F.col("doc_id") + 1).alias("merged"))
    hides = events(spark, d).filter("event_type = 'error'").select(F.col("event_id").alias("id"), "ts")
    return C.visible(s, hides.withColumn("id", F.col("id") % 1000), now).select("id")


def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("lang").alias("sentiment"), F.col("text").alias("title"))
    one = C.facets(s, sentiment="en", query="License").withColumn("which", F.lit("en"))
    return one.union(C.facets(s, sentiment="fr", query="the").withColumn("which", F.lit("fr"))).select("which", "id", "category")


def missing_sources(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("enabled"))
    return C.disabled_missing(known, table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"))).groupBy("enabled").agg(F.count("*").alias("n"))


def poll_clock(spark: SparkSession, d: str) -> DataFrame:
    """Errors stand for network failures: they don't move a source's clock."""
    e = events(spark, d).select(F.col("user_id").alias("source_id"), F.unix_seconds("ts").alias("ts"), F.when(F.col("event_type") == "error", "network").otherwise("ok").alias("outcome"))
    state = e.select("source_id").distinct().withColumn("last_polled_at", F.when(F.col("source_id") % 3 == 0, F.lit(1_706_600_000).cast("long")))
    return C.after_poll(state, e)


def repaired_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = stories(spark, d).withColumns({"band": F.when(F.col("id") % 2 == 1, None).otherwise(F.col("band")), "extract_text": F.col("body")})
    return C.repaired(rows).groupBy("extract_status").agg(F.count("*").alias("n"), F.count_if(F.col("extract_text").isNull()).alias("empty"))


def image_backfill(spark: SparkSession, d: str) -> DataFrame:
    rows = stories(spark, d).withColumn("discovered_at", F.timestamp_seconds("ts"))
    return C.backfill_images(rows, F.lit("2023-11-19 00:00:00").cast("timestamp")).select("id", "band")


def target_labels(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("o_custkey") % 2 == 0, "district"), F.when(F.col("o_custkey") % 3 == 0, "constituency"), F.lit("party")))
    rows = table(spark, d, "orders").select(C.target_from_tags(tags, {"constituency": "NORTH", "district": "WIDE"}).alias("target"))
    return rows.groupBy("target").agg(F.count("*").alias("n"))


def display_urls(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*(F.lit(x) for x in ("RESOLVED", "FAILED", "SKIPPED", "PENDING"))), (F.col("page_id") % 4 + 1).cast("int"))
    resolved = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("https://x.example/"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", C.display_url(status, resolved, F.col("url")).alias("shown"))


def publisher_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The publisher's host out of a payload; every third payload is broken JSON."""
    payload = F.concat(F.when(F.col("page_id") % 3 == 0, "{broken ").otherwise("{"), F.lit('"source": {"href": "'), F.col("url"), F.lit('"}}'))
    return table(spark, d, "pages").select("page_id", C.publisher_host(payload).alias("host"), host(F.col("url")).alias("same"))


def reason_kinds(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(x) for x in ("stale: published 7.0h before", "same url as alert #3", "same event as alert #4", "same place and emergency as alert #5", "new in this event: fire", "", "odd"))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").groupBy(C.reason_kind(said).alias("kind")).agg(F.count("*").alias("n"))


def shared_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Whether the names said to be shared stand in the text: all, or two of them."""
    shared = F.when(F.col("doc_id") % 2 == 0, "license, mit, paper").otherwise("the, zzz")
    return table(spark, d, "documents").select("doc_id", C.has_evidence(F.col("text"), shared, F.lit(True)).alias("held"))


def visit_filter(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda col, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col(col) % len(xs) + 1).cast("int"))
    r = table(spark, d, "events").select("event_id", pick("event_id", "GET", "GET", "POST").alias("method"), pick("user_id", "/", "/a.html", "/data.json").alias("path"), pick("event_id", 200, 304, 404, 200).alias("status"), pick("user_id", "text/html; charset=utf-8", None).alias("content_type"), pick("event_id", None, "prefetch", None, None, None).alias("purpose"))
    return C.loggable_visits(r).groupBy("path", "status").agg(F.count("*").alias("n"))


def coverage_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = stories(spark, d).withColumn("digested_at", F.when(F.col("id") % 10 == 0, "2023-11-01"))
    sent = C.covered(rows, rows.filter(C.kept()), F.lit(True), F.lit("2023-11-20"))
    failed = C.covered(rows, rows.filter(C.kept()), F.lit(False), F.lit("2023-11-20"))
    count = lambda df, name: df.groupBy("digested_at").agg(F.count("*").alias("n")).withColumn("brief", F.lit(name))
    return count(sent, "sent").union(count(failed, "failed"))


def edit_coalescing(spark: SparkSession, d: str) -> DataFrame:
    """A user's clicks as edits of one alert: the last body, unless it is the one that was sent."""
    e = table(spark, d, "events").filter("event_type = 'click'").select(F.col("user_id").alias("alert"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 100).cast("string").alias("body"), F.lit("0").alias("sent_body"))
    return C.coalesced_edits(e)


def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("section"), F.min("text").alias("text")).select("section", F.col("turn").alias("place"), F.col("conv_id").alias("id"), "text", (F.col("conv_id") % 2 == 0).alias("named"))
    return C.summary_lines(lines, r"the", most=5).select("section", "id", "rank")


def title_containment(spark: SparkSession, d: str) -> DataFrame:
    """Titles (here: first lines, and those without their first word) of which one holds the other."""
    t = table(spark, d, "documents").filter(F.length(F.substring_index("text", "\n", 1)) >= 30).select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"))
    cut = t.select((F.col("id") + 1_000_000).alias("id"), F.regexp_replace("title", r"^\S+\s", "").alias("title"))
    return C.title_inside_links(t.union(cut).select("id", norm_title(F.col("title")).alias("ntitle")))


def alert_queue(spark: SparkSession, d: str) -> DataFrame:
    """events as a delivery queue."""
    kind = F.when(F.col("event_id") % 4 == 0, "EDIT").otherwise("URGENT")
    status = F.element_at(F.array(*(F.lit(x) for x in ("SENT", "PENDING", "SUPPRESSED", "FAILED"))), (F.col("event_id") % 5 % 4 + 1).cast("int"))
    return events(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("item_id"), kind.alias("kind"), status.alias("status"), F.unix_seconds("ts").alias("created_s"), (F.unix_seconds("ts") + F.floor("value").cast("long")).alias("sent_s"))


def queue_status(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by status, and the median delay of what was sent in the last seven days."""
    q = alert_queue(spark, d)
    now = 1_706_659_200  # 2024-01-31
    delay = F.when((F.col("status") == "SENT") & (F.col("created_s") >= now - 7 * 86400), F.col("sent_s") - F.col("created_s"))
    return q.groupBy("kind", "status").agg(F.count("*").alias("n"), F.round(F.median(delay), 3).alias("median_delay"))


def queue_with_items(spark: SparkSession, d: str) -> DataFrame:
    """Sent alerts with their items, and all alerts with the item's segment where there is one."""
    q, c = alert_queue(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), "c_mktsegment")
    inner = q.filter("status = 'SENT'").join(c, "item_id").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("join", F.lit("inner"))
    left = q.filter("item_id % 2 = 0").join(c.filter("item_id % 4 = 0"), "item_id", "left").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("join", F.lit("left"))
    return inner.union(left)


def open_members(spark: SparkSession, d: str) -> DataFrame:
    """Orders (members) of customers (events) that aren't closed."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("event_id"), F.when(F.col("c_acctbal") < 0, "CLOSED").otherwise("OPEN").alias("status"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("event_id"), "o_orderkey")
    return o.join(c.filter("status <> 'CLOSED'"), "event_id").groupBy("event_id").agg(F.count("*").alias("members"), F.max("o_orderkey").alias("last_id"))


def resolve_durations(spark: SparkSession, d: str) -> DataFrame:
    """Per event type: rows, those that took any time, and their mean duration."""
    took = F.when(F.col("value") > 50, F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(took).alias("timed"), F.round(F.avg(took), 4).alias("mean_s"))


def log_span(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).agg(F.count("*").alias("n"), F.round((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 86400, 4).alias("days"))


def source_bands(spark: SparkSession, d: str) -> DataFrame:
    """Per source: stories, kept ones, and the sum of the scores of the kept."""
    return stories(spark, d).groupBy("host").agg(F.count("*").alias("n"), F.count_if(C.kept()).alias("kept"), F.sum(F.when(C.kept(), F.col("score"))).cast("long").alias("score"))


def matched_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Terms of JSON lists that begin with a mark, the twelve most frequent."""
    lists = F.from_json(F.concat(F.lit('["-w'), (F.col("event_id") % 9).cast("string"), F.lit('", "w'), (F.col("event_id") % 4).cast("string"), F.lit('", "-x'), (F.col("user_id") % 20).cast("string"), F.lit('"]')), "array<string>")
    terms = table(spark, d, "events").select(F.explode(lists).alias("term")).filter(F.startswith("term", F.lit("-")))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(12)


def poll_totals(spark: SparkSession, d: str) -> DataFrame:
    """One row: polls, unchanged ones (here: views) and their part, new entries."""
    e = table(spark, d, "events")
    return e.agg(F.count("*").alias("polls"), F.count_if(F.col("event_type") == "view").alias("unchanged"), F.round(100.0 * F.count_if(F.col("event_type") == "view") / F.count("*"), 4).alias("unchanged_percent"), F.sum(F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(0)).cast("long").alias("entries"))


def folded_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Clusters and the rows that they fold away, for several thresholds."""
    rows = stories(spark, d).filter("extract_status = 'OK'").withColumn("band", F.xxhash64("language"))
    found = similarity.clusters_by_threshold(rows, [0.45, 0.6, 0.8])
    return found.groupBy("threshold").agg(F.countDistinct("component").alias("clusters"), (F.count("*") - F.countDistinct("component")).alias("folded"))


def merge_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of several editions added up by name."""
    each = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("edition")).agg(F.map_from_arrays(F.array(F.lit("cluster"), F.lit("title"), F.lit("event")), F.array(F.count_if(F.col("o_custkey") % 2 == 0), F.count_if(F.col("o_custkey") % 3 == 0), F.count("*"))).alias("counters"))
    return each.select(F.explode("counters").alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"), F.max("n").alias("most"))


def key_regroup(spark: SparkSession, d: str) -> DataFrame:
    """Old keys (host and first path part) that several new keys (host and whole path) fall under."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^\w+://([^/?#]+/?[^/?#]*)", 1).alias("old"), F.regexp_extract("url", r"^\w+://([^?#]+)", 1).alias("new"))
    return p.groupBy("old").agg(F.countDistinct("new").alias("keys"), F.count("*").alias("rows")).filter("keys > 1")


def display_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Clipped, escaped and formatted values as reports show them."""
    return table(spark, d, "part").select("p_partkey", R.clipped(F.col("p_name"), 10).alias("name"), R.table_cell(F.concat(F.col("p_brand"), F.lit("|x"))).alias("cell"), R.percent(F.col("p_size"), F.lit(50)).alias("part"), R.band_mark(F.element_at(F.array(*(F.lit(b) for b in BANDS)), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("mark"))


PLACES = {"insults": ["moron", "clown"], "papers": ["license", "apache"], "things": ["trash", "thing"]}


def place_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of a table of places that each whole text names."""
    return table(spark, d, "documents").select("doc_id", F.array_join(places(F.col("text"), PLACES), ",").alias("groups"))


TS = "epoch_us(ts) // 1000000"
QUEUE = f"q AS (SELECT event_id AS id, user_id AS item_id, CASE WHEN event_id % 4 = 0 THEN 'EDIT' ELSE 'URGENT' END AS kind, ['SENT', 'PENDING', 'SUPPRESSED', 'FAILED'][event_id % 5 % 4 + 1] AS status, {TS} AS created_s, {TS} + floor(value)::BIGINT AS sent_s FROM events)"
NT = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}_\\x{{0B80}}-\\x{{0BFF}}]+', ' ', 'g'))"

PLANS = {
    "event_assign": (event_assign, ASSIGN_SQL),
    "event_states": (event_states, STATES_SQL),
    "replay_counts": (replay_counts, REPLAY_SQL),
    "candidate_scope": (candidate_scope, f"""WITH {STORIES} SELECT id, coalesce(nullif(manual_at, ''), published_at, discovered_at) AS effective_at FROM st WHERE rules_at IS NOT NULL AND coalesce(nullif(manual_at, ''), rules_at) >= '{SINCE}'
        AND (band <> 'DROP' OR urgent) AND coalesce(nullif(manual_at, ''), published_at, discovered_at) >= '{PUBLISHED_SINCE}' AND discovered_at < '2023-11-24 00:00:00'"""),
    "best_first_order": (best_first_order, f"WITH {STORIES} SELECT id, priority, (CASE WHEN n_chars > 0 THEN length(body) ELSE 0 END)::INTEGER AS detail FROM st ORDER BY coalesce(nullif(priority, 0), 9), urgent DESC, score DESC, detail DESC, published_at DESC NULLS LAST, id LIMIT 60"),
    "resolver_queue": (resolver_queue, "SELECT event_id AS id, user_id % 6 AS attempts FROM events WHERE event_type = 'view' AND user_id % 6 < 4 ORDER BY event_id DESC LIMIT 200"),
    "top_similar_pairs": (top_similar_pairs, f"""WITH i AS (SELECT doc_id, source, lang, {SIM_NORM.format('substr(text, 1, 1200)')} AS s FROM documents WHERE n_chars >= 400), g AS (SELECT doc_id, source, lang, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1)), lambda k: substr(s, k, 4))) AS gs FROM i),
        u AS (SELECT doc_id, source, lang, len(gs) AS n, unnest(gs) AS gram FROM g), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*)::DOUBLE / (a.n + b.n - count(*)) AS similarity FROM u a JOIN u b ON a.gram = b.gram AND a.lang = b.lang AND a.doc_id < b.doc_id AND a.source <> b.source GROUP BY a.doc_id, b.doc_id, a.n, b.n)
        SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.45 ORDER BY p.similarity DESC, a, b LIMIT 25"""),
    "section_order": (section_order, "WITH c AS (SELECT ['added', 'political', 'odd', 'mention', 'district'][o_custkey % 5 + 1] AS category FROM orders) SELECT category, coalesce(nullif(list_position(['mention', 'constituency', 'district', 'portfolio', 'political', 'added'], category), 0), 7)::INTEGER AS section_place, count(*) AS n FROM c GROUP BY 1, 2"),
    "manual_changes": (manual_changes, MANUAL_SQL),
    "scrub_editions": (scrub_editions, """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS edition, o_orderkey AS id, o_custkey % 2 = 0 AS shown, EXISTS (SELECT 1 FROM orders h WHERE h.o_orderkey % 40 = 0 AND h.o_orderkey IN (orders.o_orderkey, orders.o_orderkey + 1)) AS bad FROM orders)
        SELECT edition, count(*) FILTER (NOT bad) AS "left", count(*) FILTER (NOT bad AND shown) AS shown, bool_or(bad) AS changed, min(id) FILTER (NOT bad) AS first_id FROM o GROUP BY 1"""),
    "client_hides": (client_hides, f"""WITH h AS (SELECT DISTINCT event_id % 1000 AS gone FROM events WHERE event_type = 'error' AND 1706659200 - {TS} <= 72 * 3600) SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT gone FROM h) AND doc_id + 1 NOT IN (SELECT gone FROM h)"""),
    "facet_filter": (facet_filter, "SELECT lang AS which, doc_id AS id, source AS category FROM documents WHERE lang = 'en' AND contains(lower(text), 'license') OR lang = 'fr' AND contains(lower(text), 'the')"),
    "missing_sources": (missing_sources, "SELECT c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders) AS enabled, count(*) AS n FROM customer GROUP BY 1"),
    "poll_clock": (poll_clock, f"SELECT user_id AS source_id, greatest(max({TS}) FILTER (event_type <> 'error'), CASE WHEN user_id % 3 = 0 THEN 1706600000 END)::BIGINT AS last_polled_at FROM events GROUP BY user_id"),
    "repaired_pages": (repaired_pages, f"WITH {STORIES}, r AS (SELECT *, extract_status <> 'FAILED' AND http_status >= 400 AND id % 2 = 1 AS bad FROM st) SELECT CASE WHEN bad THEN 'FAILED' ELSE extract_status END AS extract_status, count(*) AS n, count(*) FILTER (bad OR body IS NULL) AS empty FROM r GROUP BY 1"),
    "image_backfill": (image_backfill, f"WITH {STORIES} SELECT id, band FROM st WHERE band <> 'DROP' AND image_url IS NULL AND 1700352000 - ts <= 3 * 86400 ORDER BY id DESC LIMIT 40"),
    "target_labels": (target_labels, "SELECT CASE WHEN o_custkey % 3 = 0 THEN 'NORTH' WHEN o_custkey % 2 = 0 THEN 'WIDE' END AS target, count(*) AS n FROM orders GROUP BY 1"),
    "display_urls": (display_urls, "SELECT page_id, CASE WHEN page_id % 4 IN (0, 2) AND page_id % 3 <> 0 THEN 'https://x.example/' || page_id ELSE url END AS shown FROM pages"),
    "publisher_hosts": (publisher_hosts, r"WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^\w+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages) SELECT page_id, host, host AS same FROM h"),
    "reason_kinds": (reason_kinds, "SELECT ['stale', 'same url', 'same event', 'same place', 'update', 'new', 'other'][event_id % 7 + 1] AS kind, count(*) AS n FROM events GROUP BY 1"),
    "shared_evidence": (shared_evidence, """WITH w AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['license', 'mit', 'paper'] ELSE ['the', 'zzz'] END AS ws, lower(text) AS t FROM documents), h AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: contains(t, x))) AS hits FROM w) SELECT doc_id, hits = n OR hits >= 2 AS held FROM h"""),
    "visit_filter": (visit_filter, """WITH r AS (SELECT ['GET', 'GET', 'POST'][event_id % 3 + 1] AS method, ['/', '/a.html', '/data.json'][user_id % 3 + 1] AS path, [200, 304, 404, 200][event_id % 4 + 1]::INTEGER AS status, user_id % 2 = 0 AS html, event_id % 5 = 1 AS ahead FROM events)
        SELECT path, status, count(*) AS n FROM r WHERE method = 'GET' AND path <> '/data.json' AND status < 400 AND (html OR status = 304) AND NOT ahead GROUP BY 1, 2"""),
    "coverage_marks": (coverage_marks, f"WITH {STORIES} SELECT CASE WHEN id % 10 = 0 THEN '2023-11-01' WHEN band <> 'DROP' THEN '2023-11-20' END AS digested_at, count(*) AS n, 'sent' AS brief FROM st GROUP BY 1 UNION ALL SELECT CASE WHEN id % 10 = 0 THEN '2023-11-01' END, count(*), 'failed' FROM st GROUP BY 1"),
    "edit_coalescing": (edit_coalescing, "WITH e AS (SELECT user_id AS alert, arg_max(floor(value / 100)::BIGINT::VARCHAR, event_id) AS body, max(event_id) AS seq FROM events WHERE event_type = 'click' GROUP BY 1) SELECT * FROM e WHERE body <> '0'"),
    "summary_lines": (summary_lines, """WITH l AS (SELECT conv_id AS id, turn AS place, min(role) AS section, min(text) AS text FROM conversations GROUP BY 1, 2), g AS (SELECT * FROM l WHERE NOT regexp_matches(lower(text), 'the') OR id % 2 = 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY section, place) AS turn FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY place, id) AS rank FROM o WHERE turn = 1) SELECT section, id, rank::INTEGER AS rank FROM r WHERE rank <= 5"""),
    "title_containment": (title_containment, f"""WITH t AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title FROM documents WHERE length(split_part(text, chr(10), 1)) >= 30), b AS (SELECT * FROM t UNION ALL SELECT id + 1000000, regexp_replace(title, '^\\S+\\s', '') FROM t),
        n AS (SELECT id, {NT.format('title')} AS s FROM b) SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.id <> y.id AND x.s <> y.s AND length(x.s) >= 30 AND length(y.s) >= 30 AND contains(y.s, x.s)"""),
    "place_groups": (place_groups, "SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), 'moron|clown') THEN 'insults' END, CASE WHEN regexp_matches(lower(text), 'license|apache') THEN 'papers' END, CASE WHEN regexp_matches(lower(text), 'trash|thing') THEN 'things' END) AS groups FROM documents"),
    "queue_status": (queue_status, f"WITH {QUEUE} SELECT kind, status, count(*) AS n, round(median(CASE WHEN status = 'SENT' AND created_s >= 1706659200 - 604800 THEN sent_s - created_s END), 3) AS median_delay FROM q GROUP BY 1, 2"),
    "queue_with_items": (queue_with_items, f"""WITH {QUEUE} SELECT c_mktsegment, count(*) AS n, 'inner' AS "join" FROM q JOIN customer ON c_custkey = item_id WHERE status = 'SENT' GROUP BY 1
        UNION ALL SELECT c_mktsegment, count(*), 'left' FROM q LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 = 0) ON c_custkey = item_id WHERE item_id % 2 = 0 GROUP BY 1"""),
    "open_members": (open_members, "SELECT o_custkey AS event_id, count(*) AS members, max(o_orderkey) AS last_id FROM orders JOIN customer ON c_custkey = o_custkey AND NOT c_acctbal < 0 GROUP BY 1"),
    "resolve_durations": (resolve_durations, "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS timed, round(avg(value) FILTER (value > 50), 4) AS mean_s FROM events GROUP BY 1"),
    "log_span": (log_span, f"SELECT count(*) AS n, round((max({TS}) - min({TS})) / 86400, 4) AS days FROM events"),
    "source_bands": (source_bands, f"WITH {STORIES} SELECT host, count(*) AS n, count(*) FILTER (band <> 'DROP') AS kept, sum(score) FILTER (band <> 'DROP')::BIGINT AS score FROM st GROUP BY 1"),
    "matched_prefixes": (matched_prefixes, "WITH t AS (SELECT unnest(['-w' || event_id % 9, '-x' || user_id % 20]) AS term FROM events) SELECT term, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, term LIMIT 12"),
    "poll_totals": (poll_totals, "SELECT count(*) AS polls, count(*) FILTER (event_type = 'view') AS unchanged, round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 4) AS unchanged_percent, sum(floor(value)) FILTER (event_type = 'purchase')::BIGINT AS entries FROM events"),
    "folded_by_threshold": (folded_by_threshold, f"""WITH RECURSIVE i AS (SELECT doc_id, source, lang, {SIM_NORM.format('substr(text, 1, 1200)')} AS s FROM documents WHERE n_chars >= 400), g AS (SELECT doc_id, source, lang, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1)), lambda k: substr(s, k, 4))) AS gs FROM i),
        u AS (SELECT doc_id, source, lang, len(gs) AS n, unnest(gs) AS gram FROM g), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*)::DOUBLE / (a.n + b.n - count(*)) AS similarity FROM u a JOIN u b ON a.gram = b.gram AND a.lang = b.lang AND a.doc_id < b.doc_id AND a.source <> b.source GROUP BY a.doc_id, b.doc_id, a.n, b.n),
        e AS (SELECT t, a, b FROM p, (SELECT unnest([0.45::DOUBLE, 0.6, 0.8]) AS t) WHERE similarity >= t UNION ALL SELECT t, b, a FROM p, (SELECT unnest([0.45::DOUBLE, 0.6, 0.8]) AS t) WHERE similarity >= t),
        r(t, id, other) AS (SELECT t, a, b FROM e UNION SELECT r.t, r.id, e.b FROM r JOIN e ON r.other = e.a AND r.t = e.t), c AS (SELECT t, id, least(id, min(other)) AS component FROM r GROUP BY t, id)
        SELECT t AS threshold, count(DISTINCT component) AS clusters, count(*) - count(DISTINCT component) AS folded FROM c GROUP BY 1"""),
    "merge_counters": (merge_counters, """WITH e AS (SELECT strftime(o_orderdate, '%Y-%m') AS edition, count(*) FILTER (o_custkey % 2 = 0) AS cluster, count(*) FILTER (o_custkey % 3 = 0) AS title, count(*) AS event FROM orders GROUP BY 1), n AS (UNPIVOT e ON cluster, title, event INTO NAME name VALUE n) SELECT name, sum(n)::BIGINT AS n, max(n) AS most FROM n GROUP BY 1"""),
    "key_regroup": (key_regroup, r"WITH p AS (SELECT regexp_extract(url, '^\w+://([^/?#]+/?[^/?#]*)', 1) AS old, regexp_extract(url, '^\w+://([^?#]+)', 1) AS new FROM pages) SELECT old, count(DISTINCT new) AS keys, count(*) AS rows FROM p GROUP BY 1 HAVING count(DISTINCT new) > 1"),
    "display_helpers": (display_helpers, r"""SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 9) || '…' ELSE p_name END AS name, p_brand || '\|x' AS cell, printf('%.0f%%', 100.0 * p_size / 50) AS part, ['●', '◐', '○', '·', '·'][p_partkey % 5 + 1] AS mark FROM part"""),
}

"""Event, alert, selection and edition queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import delivery, selection
from siftline.operators import events as E
from siftline.sources import sheets, sinks
from siftline.sources.adapters import candidates, events, table


def seconds(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("s", F.unix_seconds("ts"))


def event_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return E.lifecycle(seconds(spark, d), "user_id", "s", "event_id").groupBy("key", "event_no").agg(F.count("*").alias("members"), F.count_if("reopened").alias("reopened"), F.min("id").alias("first_id"))


def silent_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.silent_sessions(seconds(spark, d).select("user_id", "s"), "user_id", "s")


def urgent_reports(spark: SparkSession, d: str) -> DataFrame:
    """Errors as urgent reports at four desks: twenty users an event, two targets, the value's half the url, k's parts groups and places."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    return seconds(spark, d).filter("event_type = 'error'").select(
        F.col("event_id").alias("id"), text("t", F.floor(F.col("user_id") / 20) % 2).alias("target"), F.col("s").alias("ts"), F.when(F.col("event_id") % 11 == 0, F.col("s") - 8 * 3600).otherwise(F.col("s")).alias("published"),
        text("e", F.concat_ws("-", F.col("user_id") % 20, F.floor(F.col("s") / 86400))).alias("event"), text("u", F.floor(F.col("value") * 2)).alias("url"), F.array(text("g", k % 3)).alias("groups"), F.array(text("p", F.floor(k / 10))).alias("places"), (F.col("user_id") % 4).alias("desk"),
    )


def alert_decisions(spark: SparkSession, d: str) -> DataFrame:
    return E.decide(urgent_reports(spark, d), "desk")


def alert_decisions_kept(spark: SparkSession, d: str) -> DataFrame:
    """The same with a retention of five days."""
    return E.decide(urgent_reports(spark, d), "desk", keep_s=KEPT_S)


KEPT_S = 5 * 86400

# State: the alerts so far, as one list of structs a desk; REMEMBERED stands for what a row may still look at.
DECISIONS_SQL = """
WITH RECURSIVE r AS (SELECT event_id AS id, user_id % 4 AS desk, epoch_us(ts) // 1000000 AS s, CASE WHEN event_id % 11 = 0 THEN 28800 ELSE 0 END AS lag, 't' || (user_id // 20) % 2 AS target, 'e' || user_id % 20 || '-' || (epoch_us(ts) // 1000000) // 86400 AS event, 'u' || floor(value * 2)::BIGINT AS url,
    'g' || (json_extract_string(props, '$.k')::INTEGER % 3) AS grp, 'p' || (json_extract_string(props, '$.k')::INTEGER // 10) AS place FROM events WHERE event_type = 'error'),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY desk ORDER BY s, id) AS k FROM r),
f(desk, k, id, target, status, reason, ref, new, alerts) AS (
  SELECT DISTINCT desk, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, []::STRUCT(id BIGINT, s BIGINT, target VARCHAR, event VARCHAR, url VARCHAR, grp VARCHAR, place VARCHAR)[] FROM o
  UNION ALL SELECT desk, k, id, target, CASE WHEN reason IN ('new', 'update') THEN 'PENDING' ELSE 'SUPPRESSED' END, reason, CASE WHEN reason IN ('stale', 'new') THEN NULL WHEN reason = 'same url' THEN same[1].id WHEN len(own) > 0 THEN own[1].id ELSE near[-1].id END, CASE WHEN reason IN ('stale', 'same url') THEN '' ELSE array_to_string(fresh, ',') END,
    CASE WHEN reason IN ('new', 'update') THEN list_append(alerts, {'id': id, 's': s, 'target': target, 'event': event, 'url': url, 'grp': grp, 'place': place}) ELSE alerts END
  FROM (SELECT *, CASE WHEN lag > 21600 THEN 'stale' WHEN len(same) > 0 THEN 'same url' WHEN len(own) = 0 AND len(near) = 0 THEN 'new' WHEN len(fresh) > 0 THEN 'update' WHEN len(own) > 0 THEN 'same event' ELSE 'same place' END AS reason
  FROM (SELECT *, CASE WHEN len(own) > 0 THEN list_concat(CASE WHEN len(list_filter(own, lambda a: a.grp = grp0)) = 0 THEN [grp0] ELSE [] END, CASE WHEN len(list_filter(own, lambda a: a.target = target0)) = 0 THEN [target0] ELSE [] END)
      WHEN len(near) > 0 AND len(list_filter(near, lambda a: a.grp = grp0)) = 0 THEN [grp0] ELSE [] END AS fresh
  FROM (SELECT o.desk, o.k, o.id, o.target, o.s, o.lag, o.event, o.url, o.grp, o.place, o.grp AS grp0, o.target AS target0, f.alerts, list_filter(f.alerts, lambda a: a.url = o.url AND REMEMBERED) AS same, list_filter(f.alerts, lambda a: a.event = o.event AND REMEMBERED) AS own,
      list_filter(f.alerts, lambda a: a.target = o.target AND a.place = o.place AND o.s - a.s <= 10800) AS near FROM f JOIN o ON o.desk = f.desk AND o.k = f.k + 1))))
SELECT id, target, status, reason, ref, new AS "update" FROM f WHERE k > 0"""


def adaptive_pacing(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "error").when((F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0), "refused").otherwise("ok")
    return E.pacing(seconds(spark, d).withColumn("outcome", outcome), "user_id", "s", "event_id", "outcome")


def delivery_retries(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(x) for x in ("ok", "rate", "network", "config", "server", "parse"))), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    rows = table(spark, d, "events").select(kind.alias("kind"), F.pmod("user_id", F.lit(8)).cast("int").alias("attempts"))
    named = rows.select("kind", "attempts", *(c.alias(n) for n, c in E.retry(F.col("kind"), F.col("attempts")).items()))
    return named.groupBy("kind", "attempts", "status", "wait_s", "counts").agg(F.count("*").alias("n"))


def scripted(i: int, sends: int) -> str:
    """What a transport would answer to a row's next send."""
    if i % 29 == 0:
        return "server"
    return ("rate", "network", "server", "config", "parse")[(i + 7 * sends) % 13] if (i + 7 * sends) % 13 < 5 else "ok"


def delivery_replay(spark: SparkSession, d: str) -> DataFrame:
    """Errors as alerts of eight channels, sent at hourly ticks: every change of status."""
    k = F.get_json_object("props", "$.k").cast("int")
    queue = seconds(spark, d).filter("event_type = 'error'").select((F.col("user_id") % 8).alias("channel"), F.col("event_id").alias("id"), F.col("s").alias("ts"), (k % 3).alias("priority"), F.when(F.col("value") > 50, 0).otherwise(2).alias("rank"))
    ticks = spark.range(8 * TICKS).select((F.col("id") % 8).alias("channel"), (F.lit(FIRST_TICK) + 3600 * F.floor(F.col("id") / 8)).alias("ts"))
    return delivery.replay(queue, ticks, scripted, most=5)


# One step is a tick's beginning (sends is -1) or one send; pend is the open rows, out what the step says.
FIRST_TICK, TICKS = 1_704_067_200, 768
REPLAY_QUEUE_SQL = f"""
WITH RECURSIVE q AS (SELECT user_id % 8 AS ch, event_id AS id, epoch_us(ts) // 1000000 AS s, json_extract_string(props, '$.k')::INTEGER % 3 * 3 + CASE WHEN value > 50 THEN 0 ELSE 2 END AS ord FROM events WHERE event_type = 'error'),
a AS (SELECT ch, greatest(0, ceil((s - {FIRST_TICK}) / 3600)::BIGINT) AS j, list({{'ord': ord, 'id': id, 's': s, 'due': 0::BIGINT, 'att': 0, 'tries': 0}}) AS fresh FROM q GROUP BY ALL),
t AS MATERIALIZED (SELECT c.ch, c.j, coalesce(a.fresh, []) AS fresh FROM (SELECT unnest(range(8)) AS ch, j FROM (SELECT unnest(range({TICKS})) AS j)) c LEFT JOIN a ON a.ch = c.ch AND a.j = c.j),
f(ch, j, sends, hold, pend, out) AS (
  SELECT ch, -1::BIGINT, 5, 0::BIGINT, []::STRUCT(ord INTEGER, id BIGINT, s BIGINT, due BIGINT, att INTEGER, tries INTEGER)[], []::STRUCT(id BIGINT, "at" BIGINT, status VARCHAR, attempts INTEGER, outcome VARCHAR)[] FROM (SELECT unnest(range(8)) AS ch)
  UNION ALL
  SELECT ch, j2, CASE WHEN begins THEN CASE WHEN now < hold THEN 5 ELSE 0 END WHEN stops THEN 5 ELSE sends + 1 END, CASE WHEN said IN ('rate', 'config') THEN greatest(hold, then_due) ELSE hold END,
    CASE WHEN begins THEN list_filter(pool, lambda x: now - x.s <= 43200) WHEN head IS NULL THEN pool WHEN final THEN list_filter(pool, lambda x: x.id <> head.id)
      ELSE list_append(list_filter(pool, lambda x: x.id <> head.id), {{'ord': head.ord, 'id': head.id, 's': head.s, 'due': then_due, 'att': att2, 'tries': head.tries + 1}}) END,
    CASE WHEN begins THEN list_transform(list_filter(pool, lambda x: now - x.s > 43200), lambda x: {{'id': x.id, 'at': now, 'status': 'EXPIRED', 'attempts': x.att, 'outcome': NULL::VARCHAR}})
      WHEN head IS NULL THEN [] ELSE [{{'id': head.id, 'at': now, 'status': CASE WHEN said IN ('ok', 'parse') THEN 'SENT' WHEN final THEN 'FAILED' ELSE 'PENDING' END, 'attempts': att2, 'outcome': said}}] END
  FROM (SELECT *, coalesce(said IN ('ok', 'parse') OR said = 'server' AND att2 >= 6, false) AS final, head IS NULL OR said IN ('rate', 'network', 'config') OR said = 'server' AND att2 < 6 AS stops,
    now + CASE said WHEN 'rate' THEN 30 WHEN 'network' THEN 60 WHEN 'config' THEN 900 ELSE least(900, (30 * 2 ** att2)::BIGINT) END AS then_due
  FROM (SELECT *, CASE WHEN said IN ('ok', 'parse', 'server') THEN head.att + 1 ELSE head.att END AS att2
  FROM (SELECT *, CASE WHEN head IS NULL THEN NULL WHEN head.id % 29 = 0 THEN 'server' ELSE coalesce(['rate', 'network', 'server', 'config', 'parse'][(head.id + 7 * head.tries) % 13 + 1], 'ok') END AS said
  FROM (SELECT *, CASE WHEN begins THEN NULL ELSE list_sort(list_filter(pool, lambda x: x.due <= now))[1] END AS head
  FROM (SELECT f.ch, f.sends, f.hold, f.sends >= 5 AS begins, t.j AS j2, {FIRST_TICK} + 3600 * t.j AS now, CASE WHEN f.sends >= 5 THEN list_concat(f.pend, t.fresh) ELSE f.pend END AS pool
    FROM f JOIN t ON t.ch = f.ch AND t.j = CASE WHEN f.sends >= 5 THEN f.j + 1 ELSE f.j END))))))
SELECT ch AS channel, o.id, o."at", o.status, o.attempts, o.outcome FROM (SELECT ch, unnest(out) AS o FROM f)"""


def quota_select(spark: SparkSession, d: str) -> DataFrame:
    return selection.quota_select(candidates(spark, d), per=5, total=260).select("id", "category", "pass")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return selection.stratified(table(spark, d, "documents"), "source", [F.asc("doc_id")], 50).select("doc_id", "source", "turn")


def first_per_host_pick(spark: SparkSession, d: str) -> DataFrame:
    return selection.first_per_group_first(table(spark, d, "documents"), "source", [F.asc("doc_id")], 30).select("doc_id", "source", "later")


def numbered_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = selection.numbered_batches(table(spark, d, "conversations"), "role", [F.asc("conv_id"), F.asc("turn"), F.asc("text")], 60)
    return rows.groupBy("role", "batch", "batches").agg(F.count("*").alias("n"))


def top_per_category(spark: SparkSession, d: str) -> DataFrame:
    return selection.top_per_group(candidates(spark, d).filter("priority <= 2"), "category", selection.selection_order(), 5).select("id", "category", "rank")


def edition_index(spark: SparkSession, d: str) -> DataFrame:
    """Counts by category and status for every edition (an order month), as the index keeps them."""
    rows = candidates(spark, d).select(F.date_format("published", "yyyy-MM").alias("edition"), "category", F.when(F.col("urgent"), "negative").otherwise("neutral").alias("sentiment"))
    return sinks.edition_index(rows, "edition", "category", "sentiment")


def edition_json(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document per segment with its five best stories."""
    top = selection.top_per_group(candidates(spark, d).filter("priority <= 2"), "category", selection.selection_order(), 5)
    stories = top.select(F.col("category").alias("key"), "id", F.concat(F.lit("order "), F.col("id").cast("string")).alias("title"), "priority", "rank")
    return sinks.edition_documents(stories, "key", "rank").select("key", F.get_json_object("document", "$.items").cast("int").alias("items"), F.get_json_object("document", "$.stories[0].id").cast("long").alias("first_id"))


def vocabulary_rows(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary sheet made of the part table, validated: good rows by tier and problems by kind."""
    tier = F.element_at(F.array(*(F.lit(x) for x in ("constituency", "civic", "crime", "oddity"))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("line"), tier.alias("tier"), F.col("p_brand").alias("term"), F.lit("en").alias("language"), F.when(F.col("p_size") % 7 == 0, "heavy").otherwise(F.col("p_size").cast("string")).alias("weight"), F.lit("").alias("group"), F.lit("include").alias("role"), F.when(F.col("p_size") % 11 == 0, "no").otherwise("yes").alias("active"))
    good, bad = sheets.vocabulary(raw)
    return good.groupBy(F.col("tier").alias("name")).agg(F.count("*").alias("n")).union(bad.groupBy("problem").agg(F.count("*").alias("n")))


def settings_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Defaults under a sheet of allowed keys."""
    sheet = table(spark, d, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    defaults = spark.createDataFrame([("k1", "one"), ("k2", "two"), ("k99", "more")], "key string, value string")
    return sheets.settings(sheet, defaults, ["k1", "k5", "k99"])


ORDER = "coalesce(priority, 9), urgent DESC, score DESC, published, id"
CAND = "cand AS (SELECT o_orderkey AS id, c_mktsegment AS category, substr(o_orderpriority, 1, 1)::INTEGER AS priority, o_totalprice AS score, o_orderdate AS published, o_orderstatus = 'F' AS urgent, o_orderkey % 97 = 0 AS manual FROM orders JOIN customer ON o_custkey = c_custkey)"

PLANS = {
    "event_lifecycle": (event_lifecycle, """WITH RECURSIVE o AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS k FROM events),
        f(key, k, id, first_s, last_s, event_no, reopened) AS (SELECT key, k, id, s, s, 1, false FROM o WHERE k = 1
          UNION ALL SELECT o.key, o.k, o.id, CASE WHEN o.s - f.last_s >= 86400 OR o.s - f.first_s >= 86400 THEN o.s ELSE f.first_s END, o.s,
            f.event_no + CASE WHEN o.s - f.last_s >= 86400 OR o.s - f.first_s >= 86400 THEN 1 ELSE 0 END,
            NOT (o.s - f.last_s >= 86400 OR o.s - f.first_s >= 86400) AND o.s - f.last_s >= 21600 FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
        SELECT key, event_no::INTEGER AS event_no, count(*) AS members, count(*) FILTER (reopened) AS reopened, min(id) AS first_id FROM f GROUP BY 1, 2"""),
    "silent_sessions": (silent_sessions, """WITH o AS (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM events), m AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) >= 21600 THEN 1 ELSE 0 END AS fresh FROM o),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS session FROM m)
        SELECT user_id, session::BIGINT AS session, count(*) AS reports, min(s)::BIGINT AS first_ts, max(s)::BIGINT AS last_ts FROM n GROUP BY 1, 2"""),
    "alert_decisions": (alert_decisions, DECISIONS_SQL.replace("REMEMBERED", "true")),
    "alert_decisions_kept": (alert_decisions_kept, DECISIONS_SQL.replace("REMEMBERED", f"o.s - a.s <= {KEPT_S}")),
    "adaptive_pacing": (adaptive_pacing, """WITH RECURSIVE o AS (SELECT event_id AS id, user_id AS key, CASE WHEN event_type = 'error' THEN 1.5::DOUBLE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 3 ELSE 0 END AS up, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS k FROM events),
        f(key, k, id, interval_s, clean) AS (SELECT key, 0, NULL::BIGINT, 2.0::DOUBLE, 0 FROM o WHERE k = 1
          UNION ALL SELECT o.key, o.k, o.id, CASE WHEN o.up > 0 THEN least(120.0, f.interval_s * o.up) WHEN f.clean + 1 >= 15 THEN greatest(1.0, f.interval_s - 0.5) ELSE f.interval_s END,
            CASE WHEN o.up > 0 OR f.clean + 1 >= 15 THEN 0 ELSE f.clean + 1 END FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
        SELECT id, key, interval_s, clean::INTEGER AS clean FROM f WHERE k > 0"""),
    "delivery_retries": (delivery_retries, """WITH r AS (SELECT ['ok', 'rate', 'network', 'config', 'server', 'parse'][event_id % 6 + 1] AS kind, (user_id % 8)::INTEGER AS attempts FROM events)
        SELECT kind, attempts, CASE WHEN kind = 'ok' THEN 'SENT' WHEN kind = 'server' AND attempts >= 6 THEN 'FAILED' WHEN kind = 'parse' THEN 'PLAIN' ELSE 'PENDING' END AS status,
          (CASE kind WHEN 'rate' THEN 30 WHEN 'network' THEN 60 WHEN 'config' THEN 900 WHEN 'server' THEN least(900, 30 * 2 ** attempts) ELSE 0 END)::INTEGER AS wait_s, kind IN ('server', 'parse') AS counts, count(*) AS n FROM r GROUP BY ALL"""),
    "delivery_replay": (delivery_replay, REPLAY_QUEUE_SQL),
    "quota_select": (quota_select, f"""WITH {CAND}, h AS (SELECT *, NOT manual AND priority <= 2 AND row_number() OVER (PARTITION BY category, manual, priority <= 2 ORDER BY {ORDER}) <= 5 AS head FROM cand),
        f AS (SELECT *, CASE WHEN manual THEN 'forced' WHEN head THEN 'head' END AS pass, row_number() OVER (PARTITION BY manual OR head ORDER BY {ORDER}) AS k FROM h), c AS (SELECT count(*) AS n FROM f WHERE pass IS NOT NULL)
        SELECT id, category, coalesce(pass, 'fill') AS pass FROM f, c WHERE pass IS NOT NULL OR k <= greatest(0, 260 - c.n)"""),
    "stratified_sample": (stratified_sample, "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, source, turn::INTEGER AS turn FROM r ORDER BY turn, source LIMIT 50"),
    "first_per_host_pick": (first_per_host_pick, "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1 AS later FROM documents) SELECT * FROM r ORDER BY later, doc_id LIMIT 30"),
    "numbered_batches": (numbered_batches, """WITH r AS (SELECT role, (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) - 1) // 60 + 1 AS batch, count(*) OVER (PARTITION BY role) AS c FROM conversations)
        SELECT role, batch::BIGINT AS batch, ceil(c / 60)::BIGINT AS batches, count(*) AS n FROM r GROUP BY ALL"""),
    "top_per_category": (top_per_category, f"WITH {CAND}, r AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY {ORDER}) AS rank FROM cand WHERE priority <= 2) SELECT id, category, rank::INTEGER AS rank FROM r WHERE rank <= 5"),
    "edition_index": (edition_index, f"WITH {CAND} SELECT strftime(published, '%Y-%m') AS edition, category, count(*) AS n, count(*) FILTER (NOT urgent) AS neutral, count(*) FILTER (urgent) AS negative, 0::BIGINT AS positive FROM cand GROUP BY 1, 2"),
    "edition_json": (edition_json, f"WITH {CAND}, r AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY {ORDER}) AS rank FROM cand WHERE priority <= 2) SELECT category AS key, (count(*) FILTER (rank <= 5))::INTEGER AS items, max(id) FILTER (rank = 1) AS first_id FROM r GROUP BY 1"),
    "vocabulary_rows": (vocabulary_rows, """WITH r AS (SELECT p_partkey AS line, ['constituency', 'civic', 'crime', 'oddity'][p_partkey % 4 + 1] AS tier, p_brand AS term, p_size % 7 = 0 AS heavy FROM part WHERE p_size % 11 <> 0),
        c AS (SELECT *, CASE WHEN tier = 'oddity' THEN 'unknown tier' WHEN heavy THEN 'weight is not a number' END AS p FROM r),
        g AS (SELECT *, row_number() OVER (PARTITION BY tier, lower(term) ORDER BY line) AS k FROM c WHERE p IS NULL)
        SELECT tier AS name, count(*) AS n FROM g WHERE k = 1 GROUP BY 1 UNION ALL SELECT p, count(*) FROM c WHERE p IS NOT NULL GROUP BY 1 UNION ALL SELECT 'duplicate', count(*) FROM g WHERE k > 1 HAVING count(*) > 0"""),
    "settings_overlay": (settings_overlay, """WITH s AS (SELECT 'k' || n_nationkey AS key, n_name AS value FROM nation WHERE 'k' || n_nationkey IN ('k1', 'k5', 'k99')), d(key, value) AS (VALUES ('k1', 'one'), ('k2', 'two'), ('k99', 'more'))
        SELECT coalesce(s.key, d.key) AS key, coalesce(s.value, d.value) AS value FROM d FULL JOIN s ON s.key = d.key"""),
}

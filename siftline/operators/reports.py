"""Operational, evaluation and publication aggregates. All native; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Kolkata"


def local_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def quota_day(ts: Column, hours: int = 7) -> Column:
    """The day a budget belongs to, which starts `hours` after midnight UTC."""
    return F.to_date(ts - F.make_interval(hours=F.lit(hours)))


def slot(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.when(F.hour(F.from_utc_timestamp(ts, zone)) < 12, "morning").otherwise("evening")


def day_bounds(day: Column, zone: str = LOCAL_ZONE) -> tuple[Column, Column]:
    """The UTC instants at which a local day starts and ends."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def local_text(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """An instant as local people read it."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "d MMM HH:mm")


def nearest_rank(value: Column, q: float) -> Column:
    """Nearest-rank quantile, an aggregate: element int(q (n - 1) + 0.5) of the sorted values."""
    sorted_ = F.sort_array(F.collect_list(value))
    return F.element_at(sorted_, (F.floor(F.lit(q) * (F.size(sorted_) - 1) + 0.5) + 1).cast("int"))


def nearest_rank_by(df: DataFrame, groups: list[str], value: str, q: float, name: str) -> DataFrame:
    """nearest_rank per group for groups of any size: values are counted first, then ranked by running counts."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("c_n"))
    rows = W.partitionBy(*groups)
    placed = counted.withColumns({"c_upto": F.sum("c_n").over(rows.orderBy(value)), "c_all": F.sum("c_n").over(rows)})
    wanted = F.floor(F.lit(q) * (F.col("c_all") - 1) + 0.5) + 1
    return placed.filter((F.col("c_upto") >= wanted) & (F.col("c_upto") - F.col("c_n") < wanted)).select(*groups, F.col(value).alias(name))


def upper_median_by(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """Element n // 2 of the sorted values, for groups of any size."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("c_n"))
    rows = W.partitionBy(*groups)
    placed = counted.withColumns({"c_upto": F.sum("c_n").over(rows.orderBy(value)), "c_all": F.sum("c_n").over(rows)})
    wanted = F.floor(F.col("c_all") / 2) + 1
    return placed.filter((F.col("c_upto") >= wanted) & (F.col("c_upto") - F.col("c_n") < wanted)).select(*groups, F.col(value).alias(name))


def counts(df: DataFrame, *by: str, n: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(n))


def share_of_total(df: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """Counts per value with their part of all rows in per cent."""
    each = counts(df, by)
    total = each.agg(F.sum("n").alias("total"))
    return each.join(F.broadcast(total)).select(by, "n", F.round(100.0 * F.col("n") / F.col("total"), digits).alias("percent"))  # total is one row


def ok_rate(df: DataFrame, key: str, ok: Column, top: int = 15, digits: int = 6) -> DataFrame:
    """Rows, good rows and their rate per key; the busiest keys first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok")).withColumn("ok_rate", F.round(F.col("ok") / F.col("n"), digits)).orderBy(F.desc("n"), key).limit(top)


def hourly_histogram(df: DataFrame, ts: str, latest: int = 18, width: int = 40) -> DataFrame:
    """Rows per hour of the latest hours that have any, with a bar scaled to the largest of them."""
    hours = df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("hour")).limit(latest)
    top = F.max("n").over(W.partitionBy(F.lit(1)))  # at most `latest` rows
    return hours.withColumn("bar", F.repeat(F.lit("#"), F.ceil(F.lit(float(width)) * F.col("n") / top).cast("int")))


def gaps(df: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Gaps over `minutes` between consecutive rows of a key: how many, total and longest, in whole seconds."""
    before = F.lag(ts).over(W.partitionBy(key).orderBy(ts))
    each = df.withColumn("gap_s", F.unix_seconds(F.col(ts)) - F.unix_seconds(before)).filter(F.col("gap_s") > minutes * 60)
    return each.groupBy(key).agg(F.count("*").alias("gaps"), F.sum("gap_s").alias("gap_seconds"), F.max("gap_s").alias("longest_s"))


def due(last: DataFrame, key: str, ts: str, now: Column, interval_s: int) -> DataFrame:
    """Keys never polled, or last polled at least interval_s before now."""
    return last.filter(F.col(ts).isNull() | (F.unix_seconds(now) - F.unix_seconds(F.col(ts)) >= interval_s)).select(key, ts)


def day_pivot(df: DataFrame, ts: str, kind: str, kinds: list[str], zone: str = LOCAL_ZONE) -> DataFrame:
    """Local days by kind, one column per kind (0 where none)."""
    return df.groupBy(local_day(F.col(ts), zone).alias("day")).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def cross_tab(df: DataFrame, row: str, column: str, all_name: str = "All") -> DataFrame:
    """Counts by two columns with totals of both (cube)."""
    name = lambda c: F.when(F.grouping(c) == 1, all_name).otherwise(F.col(c))
    return df.cube(row, column).agg(F.count("*").alias("n"), name(row).alias("row_name"), name(column).alias("column_name")).select("row_name", "column_name", "n")


def day_matrix(df: DataFrame, ts: str, section: str, days: int, zone: str = LOCAL_ZONE) -> DataFrame:
    """The latest `days` local days by section, with every day's total (rollup)."""
    dated = df.withColumn("day", local_day(F.col(ts), zone))
    last = dated.agg(F.max("day").alias("last_day"))
    recent = dated.join(F.broadcast(last)).filter(F.col("day") > F.date_sub("last_day", days))  # last is one row
    return recent.rollup("day", section).agg(F.count("*").alias("n"), F.when(F.grouping(section) == 1, "All").otherwise(F.col(section)).alias("section_name")).filter("day is not null").select("day", "section_name", "n")


def visit_stats(visits: DataFrame, ts: str, visitor: str, bot: Column, zone: str = LOCAL_ZONE) -> DataFrame:
    """Views, distinct visitors and bots per local day, days without a visit included."""
    each = visits.withColumn("day", local_day(F.col(ts), zone)).groupBy("day").agg(F.count_if(~bot).alias("views"), F.countDistinct(F.when(~bot, F.col(visitor))).alias("visitors"), F.count_if(bot).alias("bots"))
    calendar = each.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(each, "day", "left").select("day", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("views", "visitors", "bots")))


def visit_summary(visits: DataFrame, ts: str, now: Column, bot: Column, admin: Column, ip: str, agent: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """One row: views, distinct visitors (address and agent) and addresses of today (a local day) and of the last seven days, and the week's bots and visits to the editor's pages."""
    at = F.col(ts)
    week = at >= now - F.make_interval(days=F.lit(7))
    view = week & ~bot & ~admin
    today = view & (local_day(at, zone) == local_day(now, zone))
    who = F.concat_ws("|", ip, agent)
    count = lambda when, name: [F.count_if(when).alias(f"{name}_views"), F.countDistinct(F.when(when, who)).alias(f"{name}_visitors"), F.countDistinct(F.when(when, F.col(ip))).alias(f"{name}_ips")]
    return visits.agg(*count(today, "today"), *count(view, "week"), F.count_if(week & bot).alias("week_bots"), F.count_if(week & ~bot & admin).alias("week_admin"))


# The least rates of a probe's stages, and what seconds are slow.
FEEDS_OK, LINKS_BLOCKED, LINKS_OK, ARTICLES_OK, SLOW_S = 0.9, 0.3, 0.9, 0.7, 5.0


def probe_assessment(tries: DataFrame) -> DataFrame:
    """One row about tries (stage feeds, links or articles; host, ok, seconds, error): rates, the links' median time and refusals for too many requests, hosts whose articles fail most often, and the verdict."""
    rate = lambda stage: F.count_if((F.col("stage") == stage) & F.col("ok")) / F.nullif(F.count_if(F.col("stage") == stage), F.lit(0))
    refused = F.lower(F.coalesce("error", F.lit(""))).rlike("429|too many")
    one = tries.agg(
        *(rate(s).alias(f"{s}_rate") for s in ("feeds", "links", "articles")), F.median(F.when((F.col("stage") == "links") & F.col("ok"), F.col("seconds"))).alias("links_median"), F.count_if((F.col("stage") == "links") & refused).alias("refused")
    )
    bad = tries.filter((F.col("stage") == "articles") & ~F.col("ok")).groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(8)
    names = bad.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "host"))), lambda x: x["host"]), ", ").alias("failing"))
    verdict = (
        F.when(F.col("feeds_rate").isNull(), "no result: no feeds").when(F.col("feeds_rate") < FEEDS_OK, "no").when(F.col("links_rate").isNull(), "no result: no links").when(F.col("links_rate") < LINKS_BLOCKED, "headlines only")
        .when((F.col("links_rate") < LINKS_OK) | (F.col("articles_rate") < ARTICLES_OK), "partly").otherwise("yes")
    )
    return one.join(F.broadcast(names)).withColumns({"slow": F.coalesce(F.col("links_median") > SLOW_S, F.lit(False)), "verdict": verdict})  # one row each


def latest_other(items: DataFrame, row_id: str, key: str) -> DataFrame:
    """(id, other): for items with a key, the latest other item of the same key, if there is one."""
    top = items.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max(row_id).alias("last"), F.count("*").alias("n")).filter("n > 1")
    second = items.join(top, key).filter(F.col(row_id) < F.col("last")).groupBy(key).agg(F.max(row_id).alias("before"))
    return items.join(top.join(second, key), key).select(F.col(row_id).alias("id"), F.when(F.col(row_id) == F.col("last"), F.col("before")).otherwise(F.col("last")).alias("other"))


LEAST_DAYS = 15


def pruned(items: DataFrame, ts: str, now: Column, days: int, keep: Column) -> DataFrame:
    """Rows that a retention leaves: at most `days` old (never less than LEAST_DAYS), and those to keep (handed in, hidden) whatever their age."""
    return items.filter((F.col(ts) >= now - F.make_interval(days=F.lit(max(days, LEAST_DAYS)))) | F.coalesce(keep, F.lit(False)))


def retained(df: DataFrame, ts: str, key: str, now: Column, days: int, newest: int) -> DataFrame:
    """Rows of at most `days` age, of them the newest `newest`."""
    return df.filter(F.col(ts) >= now - F.make_interval(days=F.lit(days))).orderBy(F.desc(ts), F.desc(key)).limit(newest)


def extraction_health(items: DataFrame, by: str) -> DataFrame:
    """Rows, OK, THIN, FAILED and a diagnosis per host."""
    each = items.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col("extract_status") == s).alias(s.lower()) for s in ("OK", "THIN", "FAILED")), F.countDistinct(F.when(F.col("extract_status") == "THIN", F.col("n_chars"))).alias("thin_lengths"))
    return each.withColumn("diagnosis", F.when(F.col("ok") == F.col("n"), "good").when((F.col("thin") >= 2) & (F.col("thin_lengths") == 1), "same stub every time").when(F.col("failed") * 2 > F.col("n"), "mostly fails").otherwise("mixed"))


def precision_recall(df: DataFrame, chosen: Column, truth: Column) -> list[Column]:
    tp, fp, fn = F.count_if(chosen & truth), F.count_if(chosen & ~truth), F.count_if(~chosen & truth)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall")]


def threshold_scores(df: DataFrame, score: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """Precision and recall of `score >= threshold` for several thresholds at once, by one grouping set."""
    each = df.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    return each.groupBy("threshold").agg(*precision_recall(each, F.col(score) >= F.col("threshold"), truth))


def latest_state(log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """The newest entry per key, and how many there are."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias("state"), F.max(seq).alias("seq"), F.count("*").alias("entries"))


def beyond_seen(log: DataFrame, key: str, seq: str, seen: DataFrame) -> DataFrame:
    """Rows of an append-only log after the first `seen` of their key; a log shorter than what was seen starts again."""
    rows = W.partitionBy(key)
    placed = log.withColumns({"place": F.row_number().over(rows.orderBy(seq)), "length": F.count("*").over(rows)})
    known = placed.join(seen, key, "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return known.filter(F.col("place") > F.when(F.col("length") < F.col("seen"), 0).otherwise(F.col("seen"))).drop("place", "length", "seen")


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only one side has, in either direction (multiset difference)."""
    only_a, only_b = a.exceptAll(b).agg(F.count("*").alias("only_a")), b.exceptAll(a).agg(F.count("*").alias("only_b"))
    return only_a.join(F.broadcast(only_b))  # one row each


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new over rows of old; a null in new keeps the old value."""
    o, n = old.alias("o"), new.alias("n")
    cols = [c for c in old.columns if c != key]
    return o.join(n, key, "full_outer").select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in cols))


def clipped(text: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis where something is cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def table_cell(text: Column) -> Column:
    """Text for a cell of a pipe table."""
    return F.replace(F.regexp_replace(text, r"\s+", " "), F.lit("|"), F.lit("\\|"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.format_string("%.0f%%", (100.0 * part / whole).cast("double")))


def band_mark(band: Column) -> Column:
    return F.when(band == "AUTO_KEEP", "●").when(band == "AI", "◐").when(band == "KEYWORD_KEEP", "○").otherwise("·")


def ago(seconds: Column) -> Column:
    """A span as people say it: minutes, from two hours on hours, from two days on days."""
    whole = lambda n: F.floor(seconds / n).cast("string")
    return F.when(seconds.isNull(), "never").when(seconds < 7200, F.concat(whole(60), F.lit(" min"))).when(seconds < 172_800, F.concat(whole(3600), F.lit(" h"))).otherwise(F.concat(whole(86_400), F.lit(" d")))

"""Story links, statuses, sheets, feedback, messages and small conversions: queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import automaton, urls
from siftline.functions import text as T
from siftline.operators import candidates as C
from siftline.operators import merge, ranking, rendering, similarity
from siftline.operators import reports as R
from siftline.operators import stories as ST
from siftline.plans.similarity_plans import GRAMS, NTITLE, PAIRS, bodies
from siftline.plans.story_plans import START, STORIES, stories
from siftline.plans.text_plans import MATCH_NORM, VOCABULARY, _word
from siftline.session import written
from siftline.sources import feeds, sheets
from siftline.sources.adapters import events, table

NOW = START + 900 * 1000
COMMON = ["that", "this", "with", "from", "avec", "dans", "für", "sich", "para"]
PLACE_WORDS = {"north": ["ent", "ung"], "south": ["eau", "ción"], "east": ["thou"]}


def linked_stories(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of stories that tell one event, and why: shared words, story keys and similar headlines, within a day."""
    n = F.col("id")
    rows = stories(spark, d).select("id", "title", "language", F.timestamp_seconds("ts").alias("published"), F.element_at(F.array(*(F.lit(c) for c in ("district", "portfolio", "none"))), (n % 3 + 1).cast("int")).alias("category"),
        F.when(n % 4 == 0, F.concat(F.lit("s"), F.floor(n / 16).cast("string"), F.when(n % 32 < 16, "@x").otherwise(""))).alias("story"))
    norm = T.norm_title(F.col("title"))
    named = ST.with_core(rows, COMMON).withColumns({"title_norm": norm, "places": T.places(F.col("title"), PLACE_WORDS)}).drop("title")
    items = written(named, "story-items").withColumn("tgrams", T.grams(F.col("title_norm")))
    pairs = ST.word_links(items, 2).union(ST.story_links(items)).distinct()
    return ST.linked(pairs, items)


_STEM = "CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, -3) || 'y' WHEN ends_with(w, 'ing') AND length(w) >= 7 THEN left(w, -3) WHEN ends_with(w, 'es') AND length(w) >= 6 THEN left(w, -2) WHEN ends_with(w, 'ed') AND length(w) >= 6 THEN left(w, -2) WHEN ends_with(w, 's') AND length(w) >= 5 THEN left(w, -1) ELSE w END"
LINKED_SQL = f"""WITH {STORIES}, r AS (SELECT id, title, language, ts, ['district', 'portfolio', 'none'][id % 3 + 1] AS category, CASE WHEN id % 4 = 0 THEN 's' || (id // 16) || CASE WHEN id % 32 < 16 THEN '@x' ELSE '' END END AS story,
  trim(regexp_replace({MATCH_NORM.format('title')}, '[^\\p{{L}}\\p{{N}}_\\x{{0B80}}-\\x{{0BFF}}]+', ' ', 'g')) AS tn, lower(title) AS low FROM st),
c AS (SELECT *, list_distinct(list_transform(list_filter(list_distinct(list_transform(list_filter(regexp_extract_all(title, '\\p{{L}}+'), lambda w: length(w) >= 4 OR regexp_full_match(w, '[A-Z]{{3}}')), lambda w: lower(w))), lambda w: w NOT IN ({', '.join(f"'{w}'" for w in COMMON)})), lambda w: {_STEM})) AS core,
  CASE WHEN length(tn) >= 4 THEN list_distinct(list_transform(range(1, length(tn) - 2), lambda k: substr(tn, k, 4))) ELSE [] END AS gs,
  list_filter([CASE WHEN contains(low, 'ent') OR contains(low, 'ung') THEN 'north' END, CASE WHEN contains(low, 'eau') OR contains(low, 'ción') THEN 'south' END, CASE WHEN contains(low, 'thou') THEN 'east' END], lambda x: x IS NOT NULL) AS places FROM r),
u AS (SELECT id, category, language, ts, unnest(core) AS w FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.w = b.w AND a.category = b.category AND a.language = b.language AND a.id < b.id AND abs(a.ts - b.ts) <= 86400 GROUP BY a.id, b.id HAVING count(*) >= 2
  UNION SELECT m.a, s.id FROM (SELECT story, min(id) AS a FROM c WHERE story IS NOT NULL GROUP BY story) m JOIN c s ON s.story = m.story AND s.id <> m.a),
j AS (SELECT p.a, p.b, x.category = y.category AS sc, x.category AS cat, x.language = y.language AS sl, abs(x.ts - y.ts) <= 86400 AS near, x.story = y.story AS ss, contains(x.story, '@') AS at_, len(list_intersect(x.core, y.core)) AS shared, length(x.tn) >= 25 AND length(y.tn) >= 25 AS long,
  CASE WHEN len(x.gs) > 0 AND len(y.gs) > 0 THEN len(list_intersect(x.gs, y.gs))::DOUBLE / (len(x.gs) + len(y.gs) - len(list_intersect(x.gs, y.gs))) ELSE 0 END AS sim, len(x.places) > 0 AND len(y.places) > 0 AND NOT list_has_any(x.places, y.places) AS apart FROM p JOIN c x ON x.id = p.a JOIN c y ON y.id = p.b),
w AS (SELECT a, b, CASE WHEN apart THEN NULL WHEN ss AND at_ AND (sc OR sl AND shared >= 1) THEN 'cluster' WHEN ss AND NOT at_ AND near AND CASE WHEN sl THEN shared >= 1 ELSE sc END THEN 'story' WHEN long AND sim >= 0.5 AND near AND sl AND shared >= 1 THEN 'title'
  WHEN sc AND cat <> 'none' AND sl AND near AND (shared >= 3 AND sim >= 0.15 OR shared >= 2 AND sim >= 0.25) THEN 'words' END AS why FROM j)
SELECT a, b, why FROM w WHERE why IS NOT NULL"""


def pre_merge_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between stories before they are ranked: events, equal titles, titles inside others."""
    rows = stories(spark, d).withColumn("event", F.when(F.col("id") % 7 == 0, F.floor(F.col("id") / 40)))
    return merge.pre_links(merge.with_title_keys(rows))


def confirmed_links(spark: SparkSession, d: str) -> DataFrame:
    """Equal titles that also agree in section and language, within a day."""
    rows = merge.with_title_keys(stories(spark, d).withColumns({"category": F.col("id") % 3, "published": F.timestamp_seconds("ts")}))
    return merge.confirmed(merge.equal_title_links(rows), rows, hours=72.0)


def own_outlet_first(spark: SparkSession, d: str) -> DataFrame:
    """The longest report of each outlet and language, one outlet before all others."""
    rows = table(spark, d, "documents").select("lang", F.col("source").alias("outlet"), F.col("n_chars").alias("detail"), F.lit(0).alias("ts"), F.col("doc_id").alias("id"))
    return merge.best_per_outlet(rows, "lang", own="src5").select("lang", "outlet", "id", "place")


def blocked_items(spark: SparkSession, d: str) -> DataFrame:
    """Stories of blocked hosts (and of their subdomains) leave, but for those that were handed in."""
    hosts = spark.createDataFrame([(["src3.example", "WWW.src5.example"], "src7.example , src3.example,")], "configured array<string>, more string").select(F.explode(urls.block_list(F.col("configured"), F.col("more"))).alias("host"))
    rows = stories(spark, d).withColumns({"host": F.concat(F.when(F.col("id") % 2 == 0, "m.").otherwise(""), "host", F.lit(".example")), "manual": F.col("manual_at") != "", "matched_terms": F.when(F.col("id") % 3 == 0, F.array(F.lit("x")))})
    return urls.drop_blocked(rows, hosts).select("id", "band", "score", "urgent", F.array_join("matched_terms", "|").alias("terms"))


def pruned_stories(spark: SparkSession, d: str) -> DataFrame:
    """What a retention of ten days (so fifteen) leaves of the stories; those handed in or hidden stay."""
    rows = stories(spark, d).select("id", F.timestamp_seconds("ts").alias("at"), ((F.col("manual_at") != "") | (F.col("id") % 31 == 0)).alias("held"), F.lit(NOW + 864_000).alias("now"))
    return R.pruned(rows, "at", F.timestamp_seconds("now"), 10, F.col("held")).select("id")


def last_day_status(spark: SparkSession, d: str) -> DataFrame:
    """The stories of the last 24 hours by status, kept and dropped."""
    recent = stories(spark, d).filter((F.col("ts") > NOW - 86_400) & (F.col("ts") <= NOW))
    return recent.groupBy("extract_status").agg(F.count("*").alias("n"), F.count_if(C.kept()).alias("kept"), F.count_if(F.col("band") == "DROP").alias("dropped"), F.count_if("urgent").alias("urgent"))


def similarity_bands(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs by bands of their similarity, with how many have one quality label."""
    pairs = similarity.similar_pairs(bodies(spark, d)).withColumn("band", F.when(F.col("similarity") < 0.6, "0.45").when(F.col("similarity") < 0.75, "0.60").when(F.col("similarity") < 0.9, "0.75").otherwise("0.90"))
    label = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    both = pairs.join(label.select(F.col("doc_id").alias("a"), F.col("q").alias("qa")), "a", "left").join(label.select(F.col("doc_id").alias("b"), F.col("q").alias("qb")), "b", "left")
    return both.groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("qa").isNotNull() & F.col("qb").isNotNull()).alias("judged"), F.count_if(F.col("qa") == F.col("qb")).alias("agree"))


def upserted_sources(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' rows of a changed list over the known ones; a null keeps the old value."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    old, new = s.filter("key % 3 <> 0"), s.filter("key % 2 = 0").select("key", F.when(F.col("key") % 4 == 0, F.upper("name")).alias("name"), (F.col("balance") + 1).alias("balance"))
    return R.upsert(old, new, "key").select("key", "name", F.round("balance", 2).alias("balance"))


def ready_items(spark: SparkSession, d: str) -> DataFrame:
    """What is scored next: fetched or given up, oldest first."""
    n = F.col("id")
    rows = stories(spark, d).withColumns({"band": F.when(n % 3 == 0, F.col("band")), "extract_status": F.when(n % 5 == 0, "PENDING").otherwise(F.col("extract_status")), "resolve_status": F.when(n % 10 == 0, "FAILED").otherwise("RESOLVED")})
    return feeds.ready(rows, F.lit("2023-11-24 00:00:00")).select("id", "discovered_at")


def link_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Events as links on their way: what a resolver and an extractor make of them."""
    n = F.col("event_id")
    e = table(spark, d, "events").select(n, (n % 7 == 0).alias("blocked"), (n % 3 != 0).alias("encoded"), F.when(n % 4 == 0, "u").alias("resolved"), (n % 6).alias("attempts"), F.element_at(F.array(F.lit("youtube.com"), F.lit("m.youtube.com"), F.lit("notyoutube.com"), F.lit("x.example"), F.lit("t.social")), (n % 5 + 1).cast("int")).alias("host"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("http"), F.floor(F.col("value") * 10).cast("int").alias("chars"))
    link = feeds.resolved_status(F.col("blocked"), F.col("encoded"), F.col("resolved"), F.col("attempts"))
    page = feeds.extracted_status(F.col("host"), F.col("http"), F.col("chars"), ["youtube.com"], ["t.social"])
    return e.groupBy(link.alias("link_status"), page.alias("page_status")).agg(F.count("*").alias("n"))


def placed_by_hand(spark: SparkSession, d: str) -> DataFrame:
    """Asked section, else the verdict's, else the rules', else added."""
    part = lambda k: F.element_at(F.array(*(F.lit(x) for x in [*ranking.CATEGORIES, "bogus"])), (F.floor(F.col("event_id") / k) % 7 + 1).cast("int"))
    place = ranking.place_manual(F.when(F.col("event_id") % 3 == 0, part(1)), F.when(F.col("event_id") % 2 == 0, part(7)), part(49))
    return table(spark, d, "events").groupBy(place.alias("place")).agg(F.count("*").alias("n"))


def safe_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of an outside judge, made safe."""
    k = F.get_json_object("props", "$.k")
    raw = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, "bogus").otherwise("district").alias("category"), k.alias("priority"), F.when(F.col("event_id") % 5 == 0, F.concat(k, F.lit("x"))).otherwise(k).alias("impact"), F.when(F.col("user_id") % 3 == 0, "angry").otherwise("negative").alias("sentiment"), F.when(F.col("event_id") % 2 == 0, F.array(F.repeat("event_type", 60), F.lit("  "), "event_type", "event_type", "event_type", "event_type", "event_type")).alias("takeaways"))
    out = ranking.checked_verdict(raw)
    return out.groupBy("category", "priority", "impact", "sentiment").agg(F.count("*").alias("n"), F.sum(F.size("takeaways")).alias("notes"), F.max(F.length(F.array_join("takeaways", ""))).alias("longest"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Body or cleaned description, cut at 220 characters."""
    rows = stories(spark, d).withColumn("description", F.concat(F.lit("<p>"), F.col("title"), F.lit(" &amp; <b>more</b>\n</p>")))
    return rows.select("id", F.md5(T.snippet(F.when(F.col("id") % 6 == 0, "FAILED").otherwise(F.col("extract_status")), F.col("body"), F.col("description"))).alias("digest"))


def local_times(spark: SparkSession, d: str) -> DataFrame:
    """Local days of events with their bounds in UTC, and the first and last event as local people read them."""
    day = R.local_day(F.col("ts"))
    lo, hi = R.day_bounds(F.col("day"))
    each = events(spark, d).groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return each.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.unix_seconds(lo).alias("since"), F.unix_seconds(hi).alias("until"), R.local_text(F.col("first")).alias("first_text"), ((F.col("first") >= lo) & (F.col("last") < hi)).alias("inside"))


def escaped_texts(spark: SparkSession, d: str) -> DataFrame:
    """First lines as markup, as attributes, and back."""
    marked = F.concat(F.col("title"), F.lit(' <"a" & \'b\'> '), "host")
    link = F.concat(F.lit("<b>"), T.escape_html(marked), F.lit('</b> <a href="'), T.escape_attribute(marked), F.lit('">'), T.escape_html(F.col("host")), F.lit("</a>"))
    return stories(spark, d).select("id", F.md5(link).alias("markup"), F.md5(T.plain_of_markup(link)).alias("plain"))


def feedback_totals(spark: SparkSession, d: str) -> DataFrame:
    """Turns as posted feedback: what is accepted, by type, all and of the last week."""
    kind = F.element_at(F.array(*(F.lit(x) for x in ("Wrong", " missing", "praise", "spam", "move", "hide"))), (F.col("conv_id") % 6 + 1).cast("int"))
    posts = table(spark, d, "conversations").select(kind.alias("type"), F.col("text").alias("note"), F.when(F.col("turn") % 5 == 4, "bad").otherwise("good").alias("token"), F.timestamp_seconds(F.lit(NOW) - F.col("turn") * 2 * 86_400).alias("ts"))
    ok = sheets.accepted_feedback(posts, "good")
    totals = sheets.feedback_counts(ok.withColumnRenamed("ts", "when"), F.timestamp_seconds(F.lit(NOW)))
    return totals.join(ok.groupBy("type").agg(F.max(F.length("note")).alias("longest"), F.sum(F.length("note")).alias("chars")), "type")


def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """A content hash of each source's ids."""
    return table(spark, d, "documents").groupBy("source").agg(T.set_hash(F.col("doc_id")).alias("hash"))


def links_sheet(spark: SparkSession, d: str) -> DataFrame:
    """pages as rows of the links sheet: addresses, numbers, rows that the page wrote itself, and empty ones."""
    n = F.col("page_id")
    cell = F.when(n % 4 == 0, F.concat(F.lit("see "), F.col("url"), F.lit(").;"))).when(n % 4 == 1, F.concat(F.lit("item:"), n.cast("string"))).when(n % 4 == 2, " ")
    note = F.when(n % 8 == 2, F.concat(F.lit("On-page move: on-page move #"), n.cast("string"))).when(n % 8 == 0, "typed")
    pick = lambda words, k: F.element_at(F.array(*(F.lit(w) for w in words)), (F.floor(n / k) % len(words) + 1).cast("int"))
    raw = table(spark, d, "pages").select(n.alias("line"), cell.alias("link"), pick(["District", "hide", "show", "bogus", "mention"], 1).alias("category"), pick(["NEGATIVE", "meh", "positive"], 5).alias("sentiment"), note.alias("note"))
    return sheets.links_sheet(raw)


def channel_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a sheet of video channels over the known ones; rows without an id are problems."""
    n = F.col("s_suppkey")
    code = F.concat(F.lit("UC"), F.substring(F.md5(F.floor(n / 2).cast("string")), 1, 22))
    raw = table(spark, d, "supplier").select(n.alias("line"), F.when(n % 3 != 0, F.col("s_name")).otherwise("").alias("name"), F.when(n % 5 == 0, "@handle").otherwise(F.concat(F.lit("https://v.example/channel/"), code, F.lit("/videos"))).alias("channel_id"), F.when(n % 7 == 0, " No ").alias("enabled"), F.when(n % 4 == 0, "600").alias("poll_interval_s"))
    known = table(spark, d, "supplier").filter("s_suppkey % 6 = 0").select(code.alias("channel"), F.concat(F.lit("known "), F.col("s_name")).alias("name"), F.lit(300).alias("poll_interval_s"))
    good, bad = sheets.channels(raw, known)
    return good.select("channel", "name", F.when(F.col("enabled"), "yes").otherwise("no").alias("enabled"), F.col("poll_interval_s").cast("int").alias("interval_s")).union(bad.groupBy("problem").agg(F.count("*").alias("n")).select(F.lit(None).cast("string"), "problem", F.lit(""), F.col("n").cast("int")))


def cached_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content has a stored verdict, and those that need one."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    cache = docs.filter("doc_id % 3 = 0").groupBy(F.sha2("text", 256).alias("cache_key")).agg(F.min("lang").alias("verdict"))
    have, need = ST.with_cached(docs, cache, F.sha2("text", 256))
    return have.select("doc_id", F.col("verdict"), F.lit(True).alias("cached")).union(need.select("doc_id", F.lit(None).cast("string"), F.lit(False)))


def quiet_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alert lines: quiet groups without excerpt and mark, late ones with a note."""
    rows = stories(spark, d).filter("urgent").select("id", "title", F.array(F.element_at(F.array(F.lit("crime"), F.lit("flood"), F.lit("fire")), (F.col("id") % 3 + 1).cast("int"))).alias("groups"), F.col("ts"), (F.col("ts") + F.col("id") % 5 * 900).alias("sent"))
    excerpt, mark = rendering.quiet(F.col("groups"), F.col("title"), ["crime"])
    note = rendering.delay_note(F.timestamp_seconds("ts"), F.timestamp_seconds("sent"), F.concat(mark, F.lit("alert "), F.col("id").cast("string")))
    return rows.select("id", note.alias("head"), F.md5(excerpt).alias("excerpt"))


def story_cards(spark: SparkSession, d: str) -> DataFrame:
    """What a page shows of each story."""
    rows = stories(spark, d).select("id", F.regexp_replace("title", r"\s+", " ").alias("title"), F.col("host").alias("outlet"), F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") % 3 == 0, F.array("host", "key", "band")).otherwise(F.array("host")).alias("sources"))
    return rendering.story_card(rows).select("id", F.md5("title").alias("title_digest"), "more", F.md5("share").alias("share_digest"))


def visit_summary(spark: SparkSession, d: str) -> DataFrame:
    """events as visits: users as addresses, types as agents."""
    e = events(spark, d).withColumns({"ip": (F.col("user_id") % 40).cast("string"), "agent": F.col("event_type")})
    return R.visit_summary(e, "ts", F.lit("2024-01-30 20:00:00").cast("timestamp"), F.col("event_type") == "error", F.col("event_id") % 9 == 0, "ip", "agent")


def probe_report(spark: SparkSession, d: str) -> DataFrame:
    """events as tries of a probe."""
    e = table(spark, d, "events")
    stage = F.element_at(F.array(F.lit("feeds"), F.lit("links"), F.lit("articles")), (F.col("event_id") % 3 + 1).cast("int"))
    bad = (F.col("event_type") == "error") & (stage != "feeds")
    tries = e.select(stage.alias("stage"), F.concat(F.lit("h"), (F.col("user_id") % 15).cast("string")).alias("host"), (~bad).alias("ok"), (F.col("value") / 10).alias("seconds"), F.when(bad, F.when(F.col("user_id") % 4 == 0, "HTTP 429").when(F.col("user_id") % 4 == 1, "Too Many requests").otherwise("timeout")).alias("error"))
    out = R.probe_assessment(tries)
    return out.select(*(F.round(f"{s}_rate", 6).alias(f"{s}_rate") for s in ("feeds", "links", "articles")), F.round("links_median", 6).alias("links_median"), "refused", "failing", "slow", "verdict")


def latest_copies(spark: SparkSession, d: str) -> DataFrame:
    """For every document with copies, the latest other one."""
    return R.latest_other(table(spark, d, "documents").select("doc_id", F.md5("text").alias("key")), "doc_id", "key")


def named_places(spark: SparkSession, d: str) -> DataFrame:
    """Place groups of a table and of the vocabulary's place tiers."""
    found = automaton.named_places(spark, F.col("text"), {"papers": ["license"], "things": ["thing"]}, VOCABULARY)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(found), ",").alias("groups"))


def encoded_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses whose parameters are encoded in several ways have one key."""
    n, e = F.col("page_id"), F.lit("https://www.X.example/a/?")
    forms = [F.concat(e, F.lit("q=caf%C3%A9+au%20lait&utm_x=1&id="), n.cast("string")), F.concat(e, F.lit("id="), n.cast("string"), F.lit("&q=caf%c3%a9%20au+lait&fbclid=9")), F.concat(e, F.lit("b=%zz&B=~*&id="), n.cast("string"))]
    return table(spark, d, "pages").select("page_id", urls.canonical_key(F.element_at(F.array(*forms), (n % 3 + 1).cast("int"))).alias("key"))


def _cut_sql(c: str, n: int) -> str:
    """Without marks beyond the base letters: head of n characters, at the last space beyond 60 %."""
    head = f"regexp_replace(substr({c}, 1, {n + 1}), '.\\p{{M}}*$', '')"
    space = f"length({head}) - length(split_part({head}, ' ', -1)) - 1"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(CASE WHEN {space} > {int(0.6 * n)} THEN substr({head}, 1, {space}) ELSE {head} END) || '…' END"


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SEVEN = "['mention', 'constituency', 'district', 'portfolio', 'political', 'none', 'bogus']"

PLANS = {
    "linked_stories": (linked_stories, LINKED_SQL),
    "pre_merge_links": (pre_merge_links, f"""WITH {STORIES}, k AS (SELECT id, CASE WHEN id % 7 = 0 THEN id // 40 END AS ev, {NTITLE} AS t0 FROM st), t AS (SELECT id, ev, CASE WHEN length(t0) >= 12 THEN t0 END AS nt FROM k)
        SELECT m.a, t.id AS b FROM t JOIN (SELECT ev, min(id) AS a FROM t WHERE ev IS NOT NULL GROUP BY ev) m ON m.ev = t.ev WHERE t.id <> m.a UNION SELECT m.a, t.id FROM t JOIN (SELECT nt, min(id) AS a FROM t WHERE nt IS NOT NULL GROUP BY nt) m ON m.nt = t.nt WHERE t.id <> m.a
        UNION SELECT least(x.id, y.id), greatest(x.id, y.id) FROM t x JOIN t y ON length(x.nt) >= 30 AND length(y.nt) >= 30 AND x.nt <> y.nt AND contains(y.nt, x.nt)"""),
    "confirmed_links": (confirmed_links, f"""WITH {STORIES}, k AS (SELECT id, ts, language, {NTITLE} AS t0 FROM st), t AS (SELECT id, ts, language, CASE WHEN length(t0) >= 12 THEN t0 END AS nt FROM k), m AS (SELECT nt, min(id) AS b FROM t WHERE nt IS NOT NULL GROUP BY nt)
        SELECT x.id AS a, y.id AS b FROM t x JOIN m ON m.nt = x.nt JOIN t y ON y.id = m.b WHERE x.id <> y.id AND x.id % 3 = y.id % 3 AND x.language = y.language AND abs(x.ts - y.ts) <= 72 * 3600"""),
    "own_outlet_first": (own_outlet_first, """WITH b AS (SELECT lang, source AS outlet, n_chars AS n, doc_id AS id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id DESC) = 1)
        SELECT lang, outlet, id, (row_number() OVER (PARTITION BY lang ORDER BY outlet = 'src5' DESC, n DESC, id))::INTEGER AS place FROM b QUALIFY place <= 8"""),
    "blocked_items": (blocked_items, f"""WITH {STORIES}, b AS (SELECT *, host IN ('src3', 'src5', 'src7') AND band <> 'DROP' AND manual_at = '' AS gone, CASE WHEN id % 2 = 0 THEN 'm.' ELSE '' END || host || '.example' AS h FROM st)
        SELECT id, CASE WHEN gone THEN 'DROP' ELSE band END AS band, CASE WHEN gone THEN 0 ELSE score END AS score, urgent AND NOT gone AS urgent, CASE WHEN gone THEN CASE WHEN id % 3 = 0 THEN 'x|' ELSE '' END || 'blocked host: ' || h WHEN id % 3 = 0 THEN 'x' END AS terms FROM b"""),
    "pruned_stories": (pruned_stories, f"WITH {STORIES} SELECT id FROM st WHERE ts >= {NOW} + 864000 - 15 * 86400 OR manual_at <> '' OR id % 31 = 0"),
    "last_day_status": (last_day_status, f"WITH {STORIES} SELECT extract_status, count(*) AS n, count(*) FILTER (band <> 'DROP') AS kept, count(*) FILTER (band = 'DROP') AS dropped, count(*) FILTER (urgent) AS urgent FROM st WHERE ts > {NOW} - 86400 AND ts <= {NOW} GROUP BY 1"),
    "similarity_bands": (similarity_bands, f"""WITH {GRAMS}, {PAIRS.format(' AND a.source <> b.source')}, l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1)
        SELECT CASE WHEN similarity < 0.6 THEN '0.45' WHEN similarity < 0.75 THEN '0.60' WHEN similarity < 0.9 THEN '0.75' ELSE '0.90' END AS band, count(*) AS n, count(*) FILTER (x.q IS NOT NULL AND y.q IS NOT NULL) AS judged, count(*) FILTER (x.q = y.q) AS agree
        FROM p LEFT JOIN l x ON x.doc_id = p.a LEFT JOIN l y ON y.doc_id = p.b WHERE similarity >= 0.45 GROUP BY 1"""),
    "upserted_sources": (upserted_sources, """WITH o AS (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN upper(s_name) END AS s_name, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0)
        SELECT coalesce(o.s_suppkey, n.s_suppkey) AS key, coalesce(n.s_name, o.s_name) AS name, round(coalesce(n.s_acctbal, o.s_acctbal), 2) AS balance FROM o FULL JOIN n ON o.s_suppkey = n.s_suppkey"""),
    "ready_items": (ready_items, f"WITH {STORIES} SELECT id, discovered_at FROM st WHERE id % 3 <> 0 AND (id % 5 <> 0 OR id % 10 = 0) AND discovered_at <= '2023-11-24 00:00:00' ORDER BY discovered_at, id LIMIT 300"),
    "link_statuses": (link_statuses, """WITH e AS (SELECT event_id AS n, ['youtube.com', 'm.youtube.com', 'notyoutube.com', 'x.example', 't.social'][event_id % 5 + 1] AS host, event_type = 'error' AS bad, floor(value * 10)::INTEGER AS chars FROM events)
        SELECT CASE WHEN n % 3 = 0 THEN 'SKIPPED' WHEN n % 7 = 0 THEN 'BLOCKED' WHEN n % 4 = 0 THEN 'RESOLVED' WHEN n % 6 >= 4 THEN 'FAILED' ELSE 'PENDING' END AS link_status,
          CASE WHEN host IN ('youtube.com', 'm.youtube.com') THEN 'SKIPPED_VIDEO' WHEN host = 't.social' THEN 'SKIPPED_SOCIAL' WHEN bad THEN 'FAILED' WHEN chars >= 400 THEN 'OK' WHEN chars > 0 THEN 'THIN' ELSE 'FAILED' END AS page_status, count(*) AS n FROM e GROUP BY 1, 2"""),
    "placed_by_hand": (placed_by_hand, f"""WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN {SEVEN}[event_id % 7 + 1] END AS a, CASE WHEN event_id % 2 = 0 THEN {SEVEN}[event_id // 7 % 7 + 1] END AS v, {SEVEN}[event_id // 49 % 7 + 1] AS r FROM events)
        SELECT coalesce(CASE WHEN a NOT IN ('none', 'bogus') THEN a END, CASE WHEN v NOT IN ('none', 'bogus') THEN v END, CASE WHEN r NOT IN ('none', 'bogus') THEN r END, 'added') AS place, count(*) AS n FROM e GROUP BY 1"""),
    "safe_verdicts": (safe_verdicts, """WITH e AS (SELECT event_id AS id, user_id, event_type AS t, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
        SELECT CASE WHEN id % 4 = 0 THEN 'none' ELSE 'district' END AS category, least(3, greatest(1, k)) AS priority, least(10, greatest(1, CASE WHEN id % 5 = 0 THEN 1 ELSE k END)) AS impact, CASE WHEN user_id % 3 = 0 THEN 'neutral' ELSE 'negative' END AS sentiment, count(*) AS n,
          (5 * count(*) FILTER (id % 2 = 0))::BIGINT AS notes, max(CASE WHEN id % 2 = 0 THEN least(200, 60 * length(t)) + 4 * length(t) ELSE 0 END)::INTEGER AS longest FROM e GROUP BY ALL"""),
    "snippets": (snippets, f"""WITH {STORIES}, x AS (SELECT id, trim(regexp_replace(CASE WHEN id % 6 <> 0 AND extract_status IN ('OK', 'THIN') THEN body ELSE trim(regexp_replace(regexp_replace('<p>' || title || ' & <b>more</b>' || chr(10) || '</p>', '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) END, '\\s+', ' ', 'g')) AS t FROM st)
        SELECT id, md5({_cut_sql('t', 220)}) AS digest FROM x"""),
    "local_times": (local_times, """WITH e AS (SELECT epoch_us(ts) AS us, (ts + INTERVAL 330 MINUTE)::DATE AS day FROM events)
        SELECT day::VARCHAR AS day, count(*) AS n, epoch_us(day::TIMESTAMP) // 1000000 - 19800 AS since, epoch_us(day::TIMESTAMP) // 1000000 + 66600 AS until, strftime(make_timestamp(min(us) + 19800000000), '%-d %b %H:%M') AS first_text, true AS inside FROM e GROUP BY day"""),
    "escaped_texts": (escaped_texts, f"""WITH {STORIES}, m AS (SELECT id, host, title || ' <"a" & ''b''> ' || host AS t FROM st)
        SELECT id, md5('<b>' || {_ESC.format('t')} || '</b> <a href="' || replace({_ESC.format('t')}, '"', '&quot;') || '">' || {_ESC.format('host')} || '</a>') AS markup, md5(t || ' ' || host || ' (' || t || ')') AS plain FROM m"""),
    "feedback_totals": (feedback_totals, """WITH p AS (SELECT ['wrong', 'missing', 'praise', 'spam', 'move', 'hide'][conv_id % 6 + 1] AS type, length(substr(coalesce(text, ''), 1, 500)) AS n, turn FROM conversations WHERE turn % 5 <> 4)
        SELECT type, count(*) AS "all", count(*) FILTER (turn * 2 <= 7) AS week, max(n)::INTEGER AS longest, sum(n)::BIGINT AS chars FROM p WHERE type <> 'spam' GROUP BY 1"""),
    "id_sets": (id_sets, """WITH h AS (SELECT DISTINCT source, doc_id::VARCHAR AS x FROM documents), s AS (SELECT source, count(*) AS n, sum(('0x' || substr(sha1(x), 1, 15))::BIGINT::HUGEINT) AS t FROM h GROUP BY source) SELECT source, sha1(n || ':' || t) AS hash FROM s"""),
    "links_sheet": (links_sheet, """SELECT page_id AS line, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '[.;)|,]+$', '') ELSE 'item:' || page_id END AS ref, ['district', 'hidden', 'restore', NULL, 'mention'][page_id % 5 + 1] AS category, ['negative', NULL, 'positive'][page_id // 5 % 3 + 1] AS sentiment, CASE WHEN page_id % 8 = 2 THEN 'move' ELSE 'sheet' END AS kind
        FROM pages WHERE page_id % 4 IN (0, 1) OR page_id % 8 = 2"""),
    "channel_sheet": (channel_sheet, """WITH r AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 5 <> 0 THEN 'UC' || substr(md5((s_suppkey // 2)::VARCHAR), 1, 22) END AS ch FROM supplier),
        g AS (SELECT * FROM r WHERE ch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ch ORDER BY n) = 1), k AS (SELECT 'UC' || substr(md5((s_suppkey // 2)::VARCHAR), 1, 22) AS ch, 'known ' || s_name AS kn FROM supplier WHERE s_suppkey % 6 = 0)
        SELECT g.ch AS channel, coalesce(name, kn, g.ch) AS name, CASE WHEN n % 7 <> 0 THEN 'yes' ELSE 'no' END AS enabled, (CASE WHEN n % 4 = 0 THEN 600 WHEN kn IS NOT NULL THEN 300 ELSE 180 END)::INTEGER AS interval_s FROM g LEFT JOIN k ON k.ch = g.ch
        UNION ALL SELECT NULL, 'no channel id', '', count(*)::INTEGER FROM r WHERE ch IS NULL HAVING count(*) > 0"""),
    "cached_verdicts": (cached_verdicts, "WITH c AS (SELECT text, min(lang) AS v FROM documents WHERE doc_id % 3 = 0 GROUP BY text) SELECT doc_id, v AS verdict, c.text IS NOT NULL AS cached FROM documents d LEFT JOIN c ON d.text = c.text"),
    "quiet_alerts": (quiet_alerts, f"""WITH {STORIES} SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE '🚨 ' END || 'alert ' || id || CASE WHEN id % 5 * 15 > 30 THEN chr(10) || '(delayed by ' || (id % 5 * 15) || ' min)' ELSE '' END AS head, md5(CASE WHEN id % 3 = 0 THEN '' ELSE title END) AS excerpt FROM st WHERE urgent"""),
    "visit_summary": (visit_summary, """WITH v AS (SELECT *, event_type = 'error' AS bot, event_id % 9 = 0 AS adm, (ts + INTERVAL 330 MINUTE)::DATE = DATE '2024-01-31' AS today, (user_id % 40)::VARCHAR AS ip FROM events WHERE ts >= TIMESTAMP '2024-01-23 20:00:00'), w AS (SELECT *, NOT bot AND NOT adm AS seen, ip || '|' || event_type AS who FROM v)
        SELECT count(*) FILTER (seen AND today) AS today_views, count(DISTINCT who) FILTER (seen AND today) AS today_visitors, count(DISTINCT ip) FILTER (seen AND today) AS today_ips, count(*) FILTER (seen) AS week_views, count(DISTINCT who) FILTER (seen) AS week_visitors, count(DISTINCT ip) FILTER (seen) AS week_ips,
          count(*) FILTER (bot) AS week_bots, count(*) FILTER (NOT bot AND adm) AS week_admin FROM w"""),
    "probe_report": (probe_report, """WITH t AS (SELECT ['feeds', 'links', 'articles'][event_id % 3 + 1] AS stage, 'h' || user_id % 15 AS host, NOT (event_type = 'error' AND event_id % 3 <> 0) AS ok, value / 10 AS s, user_id % 4 < 2 AS many FROM events),
        b AS (SELECT host, count(*) AS n FROM t WHERE stage = 'articles' AND NOT ok GROUP BY host ORDER BY n DESC, host LIMIT 8), a AS (SELECT avg(ok::INTEGER) FILTER (stage = 'feeds') AS f, avg(ok::INTEGER) FILTER (stage = 'links') AS l, avg(ok::INTEGER) FILTER (stage = 'articles') AS r, median(s) FILTER (stage = 'links' AND ok) AS m, count(*) FILTER (stage = 'links' AND NOT ok AND many) AS refused FROM t)
        SELECT round(f, 6) AS feeds_rate, round(l, 6) AS links_rate, round(r, 6) AS articles_rate, round(m, 6) AS links_median, refused, (SELECT string_agg(host, ', ' ORDER BY n DESC, host) FROM b) AS failing, m > 5 AS slow,
          CASE WHEN f < 0.9 THEN 'no' WHEN l < 0.3 THEN 'headlines only' WHEN l < 0.9 OR r < 0.7 THEN 'partly' ELSE 'yes' END AS verdict FROM a"""),
    "latest_copies": (latest_copies, "SELECT a.doc_id AS id, max(b.doc_id) AS other FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id WHERE a.text <> '' GROUP BY a.doc_id"),
    "named_places": (named_places, f"""WITH n AS (SELECT doc_id, lower(text) AS low, {MATCH_NORM.format("text")} AS norm FROM documents)
        SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN contains(low, 'license') THEN 'papers' END, CASE WHEN contains(low, 'thing') THEN 'things' END, CASE WHEN {_word('pathetic')} THEN 'north' END, CASE WHEN {_word('worthless')} THEN 'south' END, CASE WHEN {_word('disgusting')} THEN 'disgusting' END, CASE WHEN {_word('thin')} THEN 'thin' END], lambda x: x IS NOT NULL)), ',') AS groups FROM n"""),
    "encoded_addresses": (encoded_addresses, "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'x.example/a?id=' || page_id || '&q=caf%C3%A9+au+lait' ELSE 'x.example/a?b=%25zz&b=~%2A&id=' || page_id END AS key FROM pages"),
    "story_cards": (story_cards, f"""WITH {STORIES}, s AS (SELECT id, host, regexp_replace(title, '\\s+', ' ', 'g') AS t, id % 3 = 0 AS many FROM st)
        SELECT id, md5({_cut_sql('t', 120)}) AS title_digest, (CASE WHEN many THEN 2 ELSE 0 END)::INTEGER AS more, md5(t || ' — ' || host || CASE WHEN many THEN ' +2' ELSE '' END || chr(10) || 'https://x/' || id) AS share_digest FROM s"""),
}

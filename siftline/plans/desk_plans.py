"""Guards, overlaps in time and place, sheet versions, messages and explanations: queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.text import norm_match, norm_title, utf16_length
from siftline.operators import candidates as C
from siftline.operators import overlap, ranking, rendering
from siftline.operators.explain import Step, explained
from siftline.plans.event_plans import seconds
from siftline.plans.similarity_plans import NTITLE
from siftline.plans.story_plans import STORIES, stories
from siftline.plans.text_plans import MATCH_NORM
from siftline.sources import versions
from siftline.sources.adapters import table

# An invented profile over words that the test tables hold.
PROFILE = ranking.Profile(
    names=["mit license"], generic=["license"], anchors=["rights"], constituency_places=["the"], outside_places=["les"], district_places=["und", "die"], portfolio=["version"], commercial=["apache", "cc"], governance=["nc"]
)
VERDICTS = ["mention", "constituency", "district", "portfolio", "political", "none"]
PLACE_SPAN_S = 3 * 3600
MESSAGE = 1200
PER_CATEGORY = 5


def place_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Errors as reports with two places each: the earlier ones of three hours at a common place, and what is new in a report."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    rows = seconds(spark, d).filter("event_type = 'error'").select(
        F.col("event_id").alias("id"), F.col("s").alias("ts"), text("t", F.floor(F.col("user_id") / 20) % 2).alias("target"), F.array(text("p", F.floor(k / 10)), text("q", F.col("user_id") % 7)).alias("places"), F.array(text("g", k % 3)).alias("groups")
    )
    return overlap.seen_near(rows, PLACE_SPAN_S).select("id", "near", "last", F.array_join("fresh", ",").alias("fresh"))


def judged(rows: DataFrame) -> DataFrame:
    """Adds a verdict and tags that follow from the row, notes, and what guards read."""
    n = F.col("id")
    tags = F.array(F.when(F.col("text_norm").rlike("worthless|pathetic"), "constituency"), F.when(n % 9 == 0, "district"), F.when(n % 10 == 0, "portfolio"), F.when(n % 4 == 0, "party"))
    verdict = F.element_at(F.array(*(F.lit(v) for v in VERDICTS)), (n % 6 + 1).cast("int"))
    notes = F.when(n % 3 == 0, F.array(F.lit("About the License of it"), F.col("host"))).when(n % 3 == 1, F.array("host"))
    return rows.withColumns({"category": verdict, "tags": F.array_compact(tags), "reason": F.lit("ranked"), "takeaways": notes})


def guarded(rows: DataFrame) -> DataFrame:
    norm = rows.withColumns({"title_norm": norm_match(F.col("title")), "text_norm": norm_match(F.col("body"))})
    return ranking.guard(judged(norm), PROFILE)


def guard_docs(spark: SparkSession, d: str) -> DataFrame:
    """What the guards make of a verdict per document."""
    return guarded(stories(spark, d)).select("id", "category", "guard", "reason", F.size(F.coalesce("takeaways", F.array().cast("array<string>"))).alias("notes"), "notes_note")


def _has(column: str, *words: str) -> str:
    return f"regexp_matches({column}, '(?:^|[^a-z0-9])(?:{'|'.join(words)})(?:[^a-z0-9]|$)')"


GUARD_SQL = f"""{STORIES}, gn AS (SELECT *, {MATCH_NORM.format("title")} AS hn, {MATCH_NORM.format("body")} AS bn FROM st),
gt AS (SELECT *, {VERDICTS}[id % 6 + 1] AS cat, regexp_matches(bn, 'worthless|pathetic') AS tc, id % 9 = 0 AS td, id % 10 = 0 AS tp, id % 4 = 0 AS ty, {_has("hn", "the")} AS inside, {_has("hn", "les")} AS outside, {_has("bn", "the")} AS local, {_has("bn", "und", "die")} AS there,
  {_has("bn", "version")} AS office, {_has("bn", "apache", "cc")} AND NOT {_has("bn", "nc")} AS sale, {_has("bn", "license")} AS generic, {_has("bn", "rights")} AS anchor, {_has("bn", "mit license")} AS exact FROM gn),
ge AS (SELECT *, exact OR generic AND (anchor OR tc OR td OR tp) AS named FROM gt),
gf AS (SELECT *, inside OR (tc OR local) AND NOT outside AS ec, td OR there AS ed, tp OR office AS ep, tc OR td OR tp OR named OR local OR there OR office AS anchored FROM ge),
gr AS (SELECT *, CASE WHEN cat <> 'none' AND sale THEN 'commercial' WHEN cat = 'mention' AND NOT named THEN 'not named' WHEN cat = 'constituency' AND NOT inside AND outside THEN 'outside' WHEN cat = 'constituency' AND NOT inside AND NOT (local OR tc) THEN 'no place'
  WHEN cat = 'constituency' AND NOT inside THEN NULL WHEN cat = 'political' AND NOT anchored THEN 'not anchored' WHEN cat NOT IN ('mention', 'none') AND named THEN 'named' END AS rule FROM gf),
gc AS (SELECT *, CASE WHEN rule = 'commercial' THEN 'none' WHEN rule = 'named' THEN 'mention' WHEN rule IS NULL THEN cat ELSE CASE WHEN named AND rule <> 'not named' THEN 'mention' WHEN ec AND rule NOT IN ('outside', 'no place') THEN 'constituency' WHEN ed THEN 'district' WHEN ep THEN 'portfolio'
  WHEN ty AND anchored AND rule <> 'not anchored' THEN 'political' ELSE 'none' END END AS category, NOT named AND id % 3 = 0 AS tainted FROM gr)"""


def explain_items(spark: SparkSession, d: str) -> DataFrame:
    """Every document's way through scoring, merging, guarding and selection."""

    def merged(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("ntitle", norm_title(F.col("title")))
        first = keyed.filter(F.length("ntitle") >= 12).groupBy(F.col("ntitle").alias("of")).agg(F.min("id").alias("first"))
        return keyed.join(first, F.col("ntitle") == F.col("of"), "left").withColumn("first", F.coalesce("first", "id")).drop("of", "ntitle")

    def chosen(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(W.partitionBy("category").orderBy("priority", F.desc("score"), "id")))

    stays = C.kept() | F.col("urgent")
    kept, top = F.col("first") == F.col("id"), F.col("rank") <= PER_CATEGORY
    steps = [
        Step("score", None, F.when(stays, "kept").otherwise("dropped"), F.concat_ws(" ", "band", "score"), stays),
        Step("merge", merged, F.when(kept, "kept").otherwise("folded"), F.col("first"), kept),
        Step("guard", lambda rows: guarded(rows).drop("title", "body", "title_norm", "text_norm"), F.coalesce("guard", F.lit("as ranked")), F.col("category"), F.col("category") != "none"),
        Step("select", chosen, F.when(top, "chosen").otherwise("left out"), F.col("rank"), top),
    ]
    return explained(stories(spark, d), steps)[0]


EXPLAIN_SQL = f"""WITH {GUARD_SQL}, s1 AS (SELECT *, band <> 'DROP' OR urgent AS ok FROM gc), t AS (SELECT *, CASE WHEN length({NTITLE}) >= 12 THEN {NTITLE} END AS nt FROM s1 WHERE ok),
s2 AS (SELECT *, CASE WHEN nt IS NULL THEN id ELSE min(id) OVER (PARTITION BY nt) END AS first FROM t), s3 AS (SELECT *, CASE WHEN tainted THEN coalesce(rule, 'notes') ELSE rule END AS said FROM s2 WHERE first = id),
s4 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority, score DESC, id) AS rank FROM s3 WHERE category <> 'none')
SELECT id, 1 AS stage_no, 'score' AS stage, CASE WHEN ok THEN 'kept' ELSE 'dropped' END AS decision, band || ' ' || score AS detail FROM s1
UNION ALL SELECT id, 2, 'merge', CASE WHEN first = id THEN 'kept' ELSE 'folded' END, first::VARCHAR FROM s2 UNION ALL SELECT id, 3, 'guard', coalesce(said, 'as ranked'), category FROM s3
UNION ALL SELECT id, 4, 'select', CASE WHEN rank <= {PER_CATEGORY} THEN 'chosen' ELSE 'left out' END, rank::VARCHAR FROM s4"""


def packed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Editions of a hundred documents: their first lines under their sources, in messages of 1,200 units."""
    rows = table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 100).cast("string").alias("edition"), F.coalesce(F.expr("try_cast(substring(source, 4) as int)"), F.lit(-1)).alias("section_order"), F.col("doc_id").cast("int").alias("line_order"),
        F.concat(F.lit("— "), F.coalesce("source", F.lit("?"))).alias("section"), F.concat(F.lit("• "), F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 400)).alias("line"),
    )
    out = rendering.packed(rows, MESSAGE)
    return out.select("edition", "message", "of", utf16_length(F.col("text")).alias("units"), F.md5("text").alias("digest"))


_UNITS = "length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]'))"
PACK_SQL = f"""WITH RECURSIVE l AS (SELECT (doc_id // 100)::VARCHAR AS edition, coalesce(TRY_CAST(substr(source, 4) AS INTEGER), -1) AS so, doc_id AS lo, '— ' || coalesce(source, '?') AS header, '• ' || substr(split_part(coalesce(text, ''), chr(10), 1), 1, 400) AS line FROM documents),
u AS (SELECT *, {_UNITS.format("line")} AS n FROM l), b AS (SELECT edition, so, max(header) AS header, sum(n + 1) + max({_UNITS.format("header")}) AS block FROM u GROUP BY ALL),
x AS (SELECT edition, so, -1 AS lo, header, header AS line, {_UNITS.format("header")} AS n, block FROM b UNION ALL SELECT u.edition, u.so, lo, u.header, line, n, 0 FROM u),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY so, lo) AS k FROM x),
f(edition, k, message, size, split, text) AS (SELECT DISTINCT edition, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, '' FROM o
  UNION ALL SELECT edition, k, message + CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN lo = -1 THEN CASE WHEN fresh THEN 0 ELSE size + 2 END + n WHEN fresh THEN {_UNITS.format("header")} + 13 ELSE size + 1 END + CASE WHEN lo = -1 THEN 0 WHEN fresh THEN n ELSE n END, CASE WHEN lo = -1 THEN block > {MESSAGE} ELSE split END,
    CASE WHEN lo = -1 THEN CASE WHEN fresh THEN '' ELSE chr(10) END || header WHEN fresh THEN header || ' (continued)' || chr(10) || line ELSE line END
  FROM (SELECT f.*, o.* EXCLUDE (edition, k), o.k AS k2, CASE WHEN lo = -1 THEN f.message = 0 OR f.size + 2 + CASE WHEN block <= {MESSAGE} THEN block ELSE n END > {MESSAGE} ELSE f.split AND f.size + 1 + n > {MESSAGE} END AS fresh FROM f JOIN o ON o.edition = f.edition AND o.k = f.k + 1) q(edition, k1, message, size, split, t0, so, lo, header, line, n, block, k, fresh))
SELECT edition, message::INTEGER AS message, (max(message) OVER (PARTITION BY edition))::INTEGER AS of, ({_UNITS.format("t")})::INTEGER AS units, md5(t) AS digest FROM (SELECT edition, message, string_agg(text, chr(10) ORDER BY k) AS t FROM f WHERE k > 0 GROUP BY ALL)"""


def sheet_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """part as fifty rows a version of a vocabulary sheet, fetched every five hours; some fetches fail, are pages, or lack places or urgent terms."""
    n, v = F.col("p_partkey"), F.floor(F.col("p_partkey") / 50).cast("long") + 1
    tier = F.element_at(F.array(*(F.lit(x) for x in ("constituency", "civic", "crime", "district", "area"))), (n % 5 + 1).cast("int"))
    usual = F.when((v % 4 == 0) & tier.isin("constituency", "district"), "area").when(F.col("p_size") % 13 == 0, "oddity").otherwise(tier)
    rows = table(spark, d, "part").select(v.alias("version"), n.alias("line"), usual.alias("tier"), F.col("p_brand").alias("term"), F.lit("en").alias("language"), F.lit("").alias("weight"), F.lit("").alias("group"), F.when(usual.isin("civic", "crime") & (F.col("p_size") % 5 == 0) & (v % 5 != 0), "urgent").otherwise("include").alias("role"), F.lit("yes").alias("active"))
    fetches = rows.select("version").distinct().select("version", (F.col("version") * 18_000).alias("fetched_at"), F.when(F.col("version") % 6 == 5, 503).otherwise(200).alias("status"), F.when(F.col("version") % 7 == 3, "<!doctype html><HTML>").otherwise("tier,term").alias("head"))
    return fetches, rows


def sheet_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions.version_states(*sheet_rows(spark, d))


def last_good_versions(spark: SparkSession, d: str) -> DataFrame:
    """Which version every event would have been scored with."""
    times = seconds(spark, d).select((F.col("s") - 1_704_067_200).alias("at"))
    return versions.last_good(versions.version_states(*sheet_rows(spark, d)), times).groupBy("version", "origin", "problem").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


VERSIONS_SQL = """p AS (SELECT p_partkey // 50 + 1 AS v, p_partkey, p_size, lower(p_brand) AS term, ['constituency', 'civic', 'crime', 'district', 'area'][p_partkey % 5 + 1] AS t0 FROM part),
q AS (SELECT *, CASE WHEN v % 4 = 0 AND t0 IN ('constituency', 'district') THEN 'area' WHEN p_size % 13 = 0 THEN 'oddity' ELSE t0 END AS tier FROM p), r AS (SELECT *, CASE WHEN tier IN ('civic', 'crime') AND p_size % 5 = 0 AND v % 5 <> 0 THEN 'urgent' ELSE 'include' END AS role FROM q),
g AS (SELECT v, count(DISTINCT (tier, term, role)) FILTER (tier <> 'oddity') AS terms, count(*) - count(DISTINCT (tier, term, role)) FILTER (tier <> 'oddity') AS bad, bool_or(tier IN ('constituency', 'district')) AS places, bool_or(role = 'urgent') AS urgent FROM r GROUP BY v),
s AS (SELECT v AS version, v * 18000 AS fetched_at, terms, bad, CASE WHEN v % 6 = 5 THEN 'HTTP 503' WHEN v % 7 = 3 THEN 'a page instead of a sheet' WHEN terms = 0 THEN 'no rows' WHEN NOT places THEN 'no place' WHEN NOT urgent THEN 'no urgent term' END AS problem FROM g)"""

PLANS = {
    "place_overlap": (place_overlap, f"""WITH r AS (SELECT event_id AS id, epoch_us(ts) // 1000000 AS s, (user_id // 20) % 2 AS target, ['p' || (json_extract_string(props, '$.k')::INTEGER // 10), 'q' || user_id % 7] AS places, 'g' || (json_extract_string(props, '$.k')::INTEGER % 3) AS grp FROM events WHERE event_type = 'error'),
        n AS (SELECT b.id, count(*) AS near, arg_max(a.id, (a.s, a.id)) AS last, bool_or(a.grp = b.grp) AS told FROM r a JOIN r b ON a.target = b.target AND b.s - a.s BETWEEN 0 AND {PLACE_SPAN_S} AND (a.s < b.s OR a.id < b.id) AND list_has_any(a.places, b.places) GROUP BY b.id)
        SELECT r.id, coalesce(near, 0) AS near, last, CASE WHEN coalesce(told, false) THEN '' ELSE grp END AS fresh FROM r LEFT JOIN n ON r.id = n.id"""),
    "guard_docs": (guard_docs, f"""WITH {GUARD_SQL} SELECT id, category, CASE WHEN tainted THEN coalesce(rule, 'notes') ELSE rule END AS guard, CASE WHEN rule IS NULL THEN 'ranked' ELSE 'ranked [guard: ' || rule || ' -> ' || category || ']' END AS reason,
        (CASE WHEN tainted THEN 0 WHEN id % 3 = 0 THEN 2 WHEN id % 3 = 1 THEN 1 ELSE 0 END)::INTEGER AS notes, CASE WHEN tainted THEN 'notes named another' END AS notes_note FROM gc"""),
    "explain_items": (explain_items, EXPLAIN_SQL),
    "packed_messages": (packed_messages, PACK_SQL),
    "sheet_versions": (sheet_versions, f"WITH {VERSIONS_SQL} SELECT version, fetched_at, terms, bad, problem FROM s"),
    "last_good_versions": (last_good_versions, f"""WITH {VERSIONS_SQL}, e AS (SELECT epoch_us(ts) // 1000000 - 1704067200 AS moment FROM events), a AS (SELECT moment, (SELECT max(version) FROM s WHERE fetched_at <= moment AND problem IS NULL) AS good, (SELECT max(version) FROM s WHERE fetched_at <= moment) AS newest FROM e)
        SELECT coalesce(good, 0) AS version, CASE WHEN good IS NULL THEN 'seed' WHEN good = newest THEN 'sheet' ELSE 'kept' END AS origin, CASE WHEN good = newest THEN NULL ELSE s.problem END AS problem, count(*) AS n, min(moment) AS first_at FROM a LEFT JOIN s ON s.version = newest GROUP BY ALL"""),
}

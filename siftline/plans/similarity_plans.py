"""Similarity, cluster, merge and re-run queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import anchored, merge, similarity
from siftline.operators.reports import same_content
from siftline.plans.text_plans import SIM_NORM
from siftline.session import written
from siftline.sources.adapters import items, table

SWEEP = [0.25, 0.35, 0.45, 0.55]


def bodies(spark: SparkSession, d: str) -> DataFrame:
    """Items with an extracted body; similar only within a language, which is the band."""
    return items(spark, d).filter("extract_status = 'OK'").withColumn("band", F.xxhash64("language"))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar_pairs(bodies(spark, d)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def similarity_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What the body similarity join reads, in blocks of 64."""
    rows = bodies(spark, d)
    names = rows.select("band", "language").distinct()
    return similarity.block_report(rows, block_rows=64).join(names, "band").drop("band")


def near_dup_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Over whole bodies."""
    return similarity.threshold_sweep(bodies(spark, d), SWEEP, chars=None)


def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.duplicate_clusters(bodies(spark, d))
    named = found.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return named.groupBy("component").agg(F.count("*").alias("members"), F.countDistinct("source").alias("sources"), F.max("id").alias("last_id"))


def event_outlets(spark: SparkSession, d: str) -> DataFrame:
    """Outlets of every cluster in order of their first report."""
    found = similarity.duplicate_clusters(bodies(spark, d))
    first = found.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id").groupBy("component", "source").agg(F.min("id").alias("first_id"))
    return first.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "source"))), lambda x: x["source"]), ",").alias("outlets"))


def title_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Whole titles (here: first lines) at the body's threshold, whatever their hosts."""
    rows = items(spark, d).filter(F.length("title") >= 12).select("id", "host", "title", F.xxhash64("language").alias("band"))
    return similarity.similar_pairs(rows, cross_host=False, text="title", chars=None).select("a", "b", F.round("similarity", 6).alias("similarity"))


def anchored_merge(spark: SparkSession, d: str) -> DataFrame:
    """Longest first; later rows join the first representative that they are similar to, by their whole bodies."""
    ranked = bodies(spark, d).withColumn("rank", F.lit(10**9) * -F.col("n_chars") + F.col("id"))
    return anchored.merge_similar(ranked).groupBy("representative").agg(F.count("*").alias("members"), F.max("id").alias("last_id")).filter("members > 1")


def equal_titles(spark: SparkSession, d: str) -> DataFrame:
    return merge.equal_title_links(merge.with_title_keys(items(spark, d)))


def rerun_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the items without those that the earlier half ran already: an equal title, a similar one (0.8), or a similar body with a title that is somewhat alike."""
    rows = written(merge.with_title_keys(items(spark, d)).withColumn("band", F.xxhash64("language")), "titled")
    half = rows.agg(F.floor((F.max("id") + 1) / 2).alias("half")).first()["half"] or 0
    old, new = rows.filter(F.col("id") < half), rows.filter(F.col("id") >= half)
    return merge.drop_reruns(new, old, merge.rerun_pairs(new, old)).select("id", "host")


def best_report_per_outlet(spark: SparkSession, d: str) -> DataFrame:
    """Per language and outlet the longest report, the eight longest outlets of each language."""
    rows = table(spark, d, "documents").select("lang", F.col("source").alias("outlet"), F.col("n_chars").alias("detail"), F.lit(0).alias("ts"), F.col("doc_id").alias("id"))
    return merge.best_per_outlet(rows, "lang").select("lang", "outlet", "detail", "id", "place")


def hidden_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal texts of which none is hidden (here: ids divisible by 7)."""
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("group"), (F.col("doc_id") % 7 == 0).alias("hidden"))
    return merge.drop_hidden_groups(rows, "group").select("doc_id", "group")


def edition_signature(spark: SparkSession, d: str) -> DataFrame:
    """What differs between two selections."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return same_content(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 3 = 0"))


GRAMS = f"""
i AS (SELECT doc_id, source, lang, {SIM_NORM.format('substr(text, 1, 1200)')} AS s FROM documents WHERE n_chars >= 400),
g AS (SELECT doc_id, source, lang, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1)), lambda k: substr(s, k, 4))) AS gs FROM i),
u AS (SELECT doc_id, source, lang, len(gs) AS n, unnest(gs) AS gram FROM g)"""
WHOLE_GRAMS = GRAMS.replace("substr(text, 1, 1200)", "text")
PAIRS = """
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.source AS sa, b.source AS sb, count(*)::DOUBLE / (a.n + b.n - count(*)) AS similarity
  FROM u a JOIN u b ON a.gram = b.gram AND a.lang = b.lang AND a.doc_id < b.doc_id{0} GROUP BY a.doc_id, b.doc_id, a.source, b.source, a.n, b.n)"""
CROSS = GRAMS + "," + PAIRS.format(" AND a.source <> b.source")
REACH = """
e AS (SELECT a, b FROM p WHERE similarity >= 0.45 UNION ALL SELECT b, a FROM p WHERE similarity >= 0.45),
r(id, other) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT id, least(id, min(other)) AS component FROM r GROUP BY id)"""
TITLES = f"""
ti AS (SELECT doc_id AS id, source AS host, lang, n_chars, split_part(text, chr(10), 1) AS title, text FROM documents)"""
# The short " - tail" rule never fires on these titles: they hold no " - ".
NTITLE = f"CASE WHEN length({SIM_NORM.format('title')}) >= 12 THEN trim(regexp_replace(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}_\\x{{0B80}}-\\x{{0BFF}}]+', ' ', 'g')) END".replace("{{", "{").replace("}}", "}")

# One step an item, longest first: the representatives so far are a list in order of rank.
MERGE_SQL = f"""WITH RECURSIVE {WHOLE_GRAMS},{PAIRS.format(" AND a.source <> b.source")}, d AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE n_chars >= 400),
l AS (SELECT id, list(other) AS links FROM (SELECT a AS id, b AS other FROM p WHERE similarity >= 0.45 UNION ALL SELECT b, a FROM p WHERE similarity >= 0.45) GROUP BY id),
o AS MATERIALIZED (SELECT d.id, d.k, coalesce(links, []) AS links FROM d LEFT JOIN l ON d.id = l.id),
f(k, id, rep, reps) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] UNION ALL
  SELECT k, id, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(reps, id) ELSE reps END FROM (SELECT o.k, o.id, f.reps, list_filter(f.reps, lambda r: list_contains(o.links, r))[1] AS hit FROM f JOIN o ON o.k = f.k + 1))
SELECT rep AS representative, count(*) AS members, max(id) AS last_id FROM f WHERE k > 0 GROUP BY 1 HAVING count(*) > 1"""
RERUN_SQL = f"""WITH {GRAMS}, {PAIRS.format('')}, {TITLES}, k AS (SELECT id, host, lang, {NTITLE} AS nt FROM ti), t AS (SELECT id, host, lang, CASE WHEN length(nt) >= 12 THEN nt END AS nt FROM k),
h AS (SELECT floor((max(id) + 1) / 2)::BIGINT AS half FROM t), w AS (SELECT id, lang, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1)), lambda k: substr(s, k, 4))) AS gs FROM (SELECT id, lang, {SIM_NORM.format('nt')} AS s FROM t WHERE nt IS NOT NULL)),
x AS (SELECT id, lang, len(gs) AS n, unnest(gs) AS gram FROM w), ts AS (SELECT a.id AS a, b.id AS b, a.lang = b.lang AS same, count(*)::DOUBLE / (a.n + b.n - count(*)) AS sim FROM x a JOIN x b ON a.gram = b.gram, h WHERE a.id < half AND b.id >= half GROUP BY a.id, b.id, a.n, b.n, a.lang, b.lang)
SELECT id, host FROM t, h WHERE id >= half AND NOT (nt IS NOT NULL AND nt IN (SELECT nt FROM t, h WHERE id < half AND nt IS NOT NULL)) AND id NOT IN (SELECT b FROM ts WHERE same AND sim >= 0.8)
  AND id NOT IN (SELECT p.b FROM p JOIN ts ON p.a = ts.a AND p.b = ts.b WHERE p.similarity >= 0.8 AND ts.sim >= 0.3)"""

PLANS = {
    "near_dup_pairs": (near_dup_pairs, f"WITH {CROSS} SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.45"),
    "similarity_blocks": (similarity_blocks, f"""WITH {GRAMS}, z AS (SELECT doc_id, lang, len(gs) AS n FROM g WHERE len(gs) > 0), o AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY n, doc_id) - 1) // 64 AS b FROM z),
        k AS (SELECT lang, b, count(*) AS n, min(n) AS least, max(n) AS most FROM o GROUP BY lang, b), r AS (SELECT x.lang, count(*) AS read FROM k x JOIN k y ON x.lang = y.lang AND x.b <= y.b AND x.most >= 0.45 * y.least GROUP BY x.lang)
        SELECT lang AS language, sum(n)::BIGINT AS n, count(*) AS blocks, count(*) * (count(*) + 1) // 2 AS block_pairs, max(read) AS read FROM k JOIN r USING (lang) GROUP BY lang"""),
    "near_dup_threshold_sweep": (near_dup_threshold_sweep, f"WITH {WHOLE_GRAMS}, {PAIRS.format('')} SELECT t AS threshold, count(*) AS pairs, count(*) FILTER (sa <> sb) AS cross_pairs, count(DISTINCT b) AS suppressed FROM p JOIN (SELECT unnest([0.25::DOUBLE, 0.35, 0.45, 0.55]) AS t) ON similarity >= t GROUP BY t"),
    "dup_clusters": (dup_clusters, f"WITH RECURSIVE {CROSS}, {REACH} SELECT component, count(*) AS members, count(DISTINCT d.source) AS sources, max(id) AS last_id FROM c JOIN documents d ON d.doc_id = c.id GROUP BY component"),
    "event_outlets": (event_outlets, f"WITH RECURSIVE {CROSS}, {REACH}, f AS (SELECT component, d.source, min(id) AS first_id FROM c JOIN documents d ON d.doc_id = c.id GROUP BY ALL) SELECT component, string_agg(source, ',' ORDER BY first_id, source) AS outlets FROM f GROUP BY component"),
    "title_dup_pairs": (title_dup_pairs, f"""WITH {TITLES}, i AS (SELECT id AS doc_id, lang, {SIM_NORM.format('title')} AS s FROM ti WHERE length(title) >= 12),
        g AS (SELECT doc_id, lang, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1)), lambda k: substr(s, k, 4))) AS gs FROM i), u AS (SELECT doc_id, lang, len(gs) AS n, unnest(gs) AS gram FROM g)
        SELECT a.doc_id AS a, b.doc_id AS b, round(count(*)::DOUBLE / (a.n + b.n - count(*)), 6) AS similarity FROM u a JOIN u b ON a.gram = b.gram AND a.lang = b.lang AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.45"""),
    "anchored_merge": (anchored_merge, MERGE_SQL),
    "equal_titles": (equal_titles, f"WITH {TITLES}, k AS (SELECT id, {NTITLE} AS ntitle FROM ti), m AS (SELECT *, min(id) OVER (PARTITION BY ntitle) AS b FROM k WHERE ntitle IS NOT NULL AND length(ntitle) >= 12) SELECT id AS a, b FROM m WHERE id <> b"),
    "rerun_antijoin": (rerun_antijoin, RERUN_SQL),
    "best_report_per_outlet": (best_report_per_outlet, """WITH b AS (SELECT lang, source AS outlet, n_chars AS detail, doc_id AS id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id DESC) AS k FROM documents),
        p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY detail DESC, id) AS place FROM b WHERE k = 1) SELECT lang, outlet, detail, id, place::INTEGER AS place FROM p WHERE place <= 8"""),
    "hidden_groups": (hidden_groups, 'SELECT doc_id, md5(text) AS "group" FROM documents QUALIFY NOT bool_or(doc_id % 7 = 0) OVER (PARTITION BY md5(text))'),
    "edition_signature": (edition_signature, """WITH a AS (SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0)
        SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b"""),
}

"""Which reports tell one story: shared identifying words, the link predicate after ranking, and re-used verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import core_terms, jaccard, shared_words, stem_en

TITLE_COMPARED, TITLE_SIM = 25, 0.5
BAND_HOURS = 24.0


def with_core(items: DataFrame, common: list[str]) -> DataFrame:
    """Adds core: the stems of the headline's identifying words."""
    return items.withColumn("core", F.array_distinct(F.transform(core_terms(F.col("title"), common), stem_en)))


def word_links(items: DataFrame, least: int = 2) -> DataFrame:
    """Pairs (a < b) of one category and language, at most a day apart, that share `least` core words.

    Joined on the words and on the day or the next one, so a word only meets the items of
    two days; which words are too common to identify a story is the caller's word list.
    """
    day = F.floor(F.unix_seconds("published") / 86400)
    # Words of scripts without case meet by their first letters, since their endings differ; linked() compares them in full.
    key = F.transform("core", lambda w: F.when(w.rlike(r"\p{Lo}"), F.substring(w, 1, 3)).otherwise(w))
    words = items.select("id", "category", "language", "published", day.alias("day"), F.explode(F.array_distinct(key)).alias("word"))
    a, b = words.alias("a"), words.withColumn("day", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1))).alias("b")
    near = F.abs(F.unix_seconds("a.published") - F.unix_seconds("b.published")) <= BAND_HOURS * 3600
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("category", "language", "word", "day")]
    pairs = a.join(b, [*same, F.col("a.id") < F.col("b.id"), near]).groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("shared"))
    return pairs.filter(F.col("shared") >= least).select("a", "b")


def story_links(items: DataFrame) -> DataFrame:
    """Pairs (a < b) with one story key: a star around the smallest id of each key."""
    first = items.filter("story is not null and story <> ''").groupBy("story").agg(F.min("id").alias("a"))
    return items.join(first, "story").filter("id <> a").select("a", F.col("id").alias("b"))


def linked(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs that the link predicate accepts, with `why`.

    items: id, category, language, published, story, title_norm, tgrams, core, places.
    Disjoint places rule a pair out, whatever else holds. Then a common story key, similar
    titles, or shared words, each confirmed by its own gate of category, language and time.
    """
    fields = ("category", "language", "published", "story", "title_norm", "tgrams", "core", "places")
    side = lambda s: items.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in fields))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    c = lambda name: (F.col(f"{name}_a"), F.col(f"{name}_b"))
    equal = lambda name: c(name)[0] == c(name)[1]
    near = F.abs(F.unix_seconds(c("published")[0]) - F.unix_seconds(c("published")[1])) <= BAND_HOURS * 3600
    shared = shared_words(*c("core"))
    sim = jaccard(*c("tgrams"))
    apart = (F.size(c("places")[0]) > 0) & (F.size(c("places")[1]) > 0) & ~F.arrays_overlap(*c("places"))
    cluster = equal("story") & F.contains(c("story")[0], F.lit("@")) & (equal("category") | equal("language") & (shared >= 1))
    told = equal("story") & ~F.contains(c("story")[0], F.lit("@")) & near & F.when(equal("language"), shared >= 1).otherwise(equal("category"))
    titles = (F.length(c("title_norm")[0]) >= TITLE_COMPARED) & (F.length(c("title_norm")[1]) >= TITLE_COMPARED) & (sim >= TITLE_SIM) & near & F.when(equal("language"), shared >= 1).otherwise(F.lit(False))
    words = equal("category") & (c("category")[0] != "none") & equal("language") & near & ((shared >= 3) & (sim >= 0.15) | (shared >= 2) & (sim >= 0.25))
    why = F.when(apart, None).when(cluster, "cluster").when(told, "story").when(titles, "title").when(words, "words")
    return both.select("a", "b", why.alias("why")).filter("why is not null")


def with_cached(items: DataFrame, cache: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with a stored verdict, rows that need one), by a content hash."""
    keyed = items.withColumn("cache_key", key)
    return keyed.join(cache, "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def image(stored: Column, payload: Column) -> Column:
    """The stored picture, else the payload's thumbnails, medium first."""
    paths = [F.get_json_object(payload, f"$.thumbnails.{k}.url") for k in ("medium", "high", "default")]
    return F.coalesce(F.nullif(stored, F.lit("")), *paths)

"""Versions of a sheet with their validity, and the last good one at any time.

Every fetch is kept as a version; none replaces what came before. A version that can't be used (an
error, a page instead of a sheet, no rows, no place, no urgent term) is passed over, so readers go on
with the newest good one, else with the seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.sources.sheets import looks_like_html, vocabulary

SEED = 0


def version_states(fetches: DataFrame, raw: DataFrame) -> DataFrame:
    """(version, fetched_at, terms, bad, problem) per fetch; problem is null where the version can be used.

    fetches: (version, fetched_at, status, head), head the answer's beginning; raw: the sheet rows of all versions, with `version`.
    """
    lines = raw.withColumn("line", F.struct("version", "line"))
    # Tiers, terms and roles are checked within a version: the version goes along in the term.
    tagged = lines.withColumn("term", F.concat(F.col("line.version").cast("string"), F.lit("\u0001"), F.trim(F.coalesce("term", F.lit("")))))
    good, bad = vocabulary(tagged)
    own = F.regexp_extract("term", "^([0-9]+)\u0001(.*)$", 2)
    usable = good.filter(own != "").groupBy(F.col("line.version").alias("of")).agg(
        F.count("*").alias("terms"), F.coalesce(F.bool_or(F.col("tier").isin("constituency", "district") & (F.col("role") != "exclude")), F.lit(False)).alias("places"), F.bool_or(F.col("role") == "urgent").alias("urgent")
    )
    wrong = bad.groupBy(F.col("line.version").alias("bad_of")).agg(F.count("*").alias("bad"))
    each = fetches.join(usable, F.col("version") == F.col("of"), "left").join(wrong, F.col("version") == F.col("bad_of"), "left")
    problem = (
        F.when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(looks_like_html(F.coalesce("head", F.lit(""))), "a page instead of a sheet")
        .when(F.col("terms").isNull(), "no rows")
        .when(~F.col("places"), "no place")
        .when(~F.col("urgent"), "no urgent term")
    )
    return each.select("version", "fetched_at", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("bad", F.lit(0)).alias("bad"), problem.alias("problem"))


def last_good(states: DataFrame, times: DataFrame) -> DataFrame:
    """(at, version, origin, problem) for every time: the newest good version so far. origin is sheet where that is the newest fetch at all, kept where later ones were bad (problem is the newest's), seed where there is none yet.

    States are few (one row per fetch), so they meet the times in one ordered pass by union; no time is compared with every version.
    """
    from pyspark.sql import Window as W

    marks = states.select(F.col("fetched_at").alias("at"), "version", "problem", F.lit(0).alias("asks"))
    asked = times.select("at", F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("problem"), F.lit(1).alias("asks"))
    hour = F.floor(F.col("at") / 86_400)  # ranges of a day; a day's first row takes over what the days before left
    both = marks.union(asked).withColumn("day", hour)
    rows = W.partitionBy("day").orderBy("at", "asks", "version")
    good = F.when((F.col("asks") == 0) & F.col("problem").isNull(), F.col("version"))
    newest = F.when(F.col("asks") == 0, F.struct("version", "problem"))
    within = both.withColumns({"good": F.last(good, True).over(rows), "newest": F.last(newest, True).over(rows)})
    ends = marks.withColumn("day", hour).groupBy("day").agg(F.max_by(good, F.when(good.isNotNull(), F.struct("at", "version"))).alias("end_good"), F.max_by(F.struct("version", "problem"), F.struct("at", "version")).alias("end_newest"))
    days = both.select("day").distinct().join(ends, "day", "left")
    before = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)  # one row per day
    left = days.select("day", F.last("end_good", True).over(before).alias("old_good"), F.last("end_newest", True).over(before).alias("old_newest"))
    out = within.filter("asks = 1").join(left, "day").select("at", F.coalesce("good", "old_good").alias("good"), F.coalesce("newest", "old_newest").alias("newest"))
    origin = F.when(F.col("good").isNull(), "seed").when(F.col("good") == F.col("newest.version"), "sheet").otherwise("kept")
    return out.select("at", F.coalesce("good", F.lit(SEED).cast("long")).alias("version"), origin.alias("origin"), F.when(origin != "sheet", F.col("newest.problem")).alias("problem"))

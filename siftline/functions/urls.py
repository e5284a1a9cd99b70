"""Url parts, canonical keys and host rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that don't change the article.
TRACKING = ["fbclid", "gclid", "igshid", "ref", "ref_src", "share", "oc", "amp", "outputtype", "cmpid", "cmp", "ito", "s_cid", "mc_cid", "mc_eid"]


def host(url: Column) -> Column:
    """Lower-case host name without one leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^\w+://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^\w+://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def video_id(url: Column) -> Column:
    """The 11-character id of a video page, or null."""
    h, p, q = host(url), path(url), query(url)
    on_site = (h == "youtube.com") | F.endswith(h, F.lit(".youtube.com"))
    short = F.regexp_extract(p, r"^/+([\w-]{11})(?:/|$)", 1)
    asked = F.regexp_extract(q, r"(?:^|&)v=([\w-]{11})(?:&|$)", 1)
    named = F.regexp_extract(p, r"^/(?:shorts|live|embed)/([\w-]{11})", 1)
    none = F.lit("")
    return F.when(h == "youtu.be", F.nullif(short, none)).when(on_site, F.coalesce(F.nullif(asked, none), F.nullif(named, none)))


def decoded(c: Column) -> Column:
    """A query's part as text; as it is where it isn't well encoded."""
    return F.coalesce(F.try_url_decode(c), c)


def encoded(c: Column) -> Column:
    """Text as a query's part: letters, digits and -._~ stay, blanks become plus signs."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_key(url: Column) -> Column:
    """One key for all addresses of an article; null for an empty url.

    Host without www., m., amp. (each once, in this order), path without amp endings
    and a last slash, both lower case; other parameters stay, sorted, in one way of encoding.
    """
    u = F.trim(url)
    h = F.regexp_replace(F.regexp_replace(host(u), r"^m\.", ""), r"^amp\.", "")
    p = F.regexp_replace(path(u), r"/amp/?$|\.amp$|/$", "")
    pairs = F.filter(F.split(query(u), "&"), lambda x: x != "")
    named = F.transform(pairs, lambda x: F.struct(F.lower(decoded(F.substring_index(x, "=", 1))).alias("k"), decoded(F.regexp_replace(x, "^[^=]*=?", "")).alias("v")))
    kept = F.filter(named, lambda x: ~x["k"].startswith("utm_") & ~x["k"].isin(TRACKING))
    text = F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(encoded(x["k"]), F.lit("="), encoded(x["v"]))), "&")
    key = F.concat(F.lower(F.concat(h, p)), F.when(F.size(kept) > 0, F.concat(F.lit("?"), text)).otherwise(""))
    video = video_id(u)
    return F.when(F.length(u) == 0, None).when(video.isNotNull(), F.concat(F.lit("youtube.com/watch?v="), video)).otherwise(key)


def item_key(link: Column) -> Column:
    """Feed token, else video id, else a hash of the link."""
    token = F.substring(F.regexp_extract(link, r"/articles/([\w-]+)", 1), 1, 120)
    return F.coalesce(F.nullif(token, F.lit("")), video_id(link), F.concat(F.lit("u:"), F.substring(F.sha2(link, 256), 1, 32)))


def host_suffixes(h: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: a suffix rule becomes an equality."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def on_hosts(df: DataFrame, host_column: str, rules: DataFrame, rule_column: str = "host") -> DataFrame:
    """df with `listed`: whether the host or a dot-bounded suffix of it is in rules. An equi join, never a nested loop."""
    hit = df.select(host_column).distinct().withColumn("rule", F.explode(host_suffixes(F.col(host_column)))).join(rules.select(F.col(rule_column).alias("rule")).distinct(), "rule", "left_semi").select(host_column).distinct().withColumn("listed", F.lit(True))
    return df.join(hit, host_column, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def block_list(configured: Column, more: Column) -> Column:
    """Configured hosts, then those of a comma-separated text, lower case, without www., each once in order."""
    clean = lambda h: F.regexp_replace(F.lower(F.trim(h)), r"^www\.", "")
    both = F.concat(F.coalesce(configured, F.array().cast("array<string>")), F.split(F.coalesce(more, F.lit("")), ","))
    return F.array_distinct(F.filter(F.transform(both, clean), lambda h: h != ""))


def drop_blocked(items: DataFrame, hosts: DataFrame, host_column: str = "host") -> DataFrame:
    """Scored items of blocked hosts leave: band DROP, score 0, not urgent, the host added to their matched terms; handed-in ones stay."""
    seen = on_hosts(items, host_column, hosts)
    gone = F.col("listed") & F.col("band").isNotNull() & (F.col("band") != "DROP") & ~F.coalesce("manual", F.lit(False))
    why = F.array(F.concat(F.lit("blocked host: "), F.col(host_column)))
    terms = F.coalesce("matched_terms", F.array().cast("array<string>"))
    return seen.withColumns({
        "band": F.when(gone, "DROP").otherwise(F.col("band")), "score": F.when(gone, 0).otherwise(F.col("score")), "urgent": F.col("urgent") & ~gone,
        "matched_terms": F.when(gone, F.concat(terms, why)).otherwise(F.col("matched_terms")),
    }).drop("listed")


def channel_id(text: Column) -> Column:
    """UC and 22 characters, alone or in a url; null where only a lookup by handle could tell."""
    return F.nullif(F.regexp_extract(text, r"(UC[\w-]{22})(?![\w-])", 1), F.lit(""))

"""Rule ranking, guards with re-filing, manual placement and verdict checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ["mention", "constituency", "district", "portfolio", "political", "none"]
SENTIMENTS = ["positive", "negative", "neutral"]
TAG_CATEGORY = [("mention", "mention"), ("constituency", "constituency"), ("district", "district"), ("portfolio", "portfolio"), ("party", "political")]


@dataclass(frozen=True)
class Profile:
    """What the guards look for, as patterns; configuration, never code."""

    names: list[str] = field(default_factory=list)
    constituency_places: list[str] = field(default_factory=list)
    outside_places: list[str] = field(default_factory=list)
    portfolio: list[str] = field(default_factory=list)
    political: list[str] = field(default_factory=list)
    district_places: list[str] = field(default_factory=list)
    generic: list[str] = field(default_factory=list)  # forms of the name that others bear too: they count beside an anchor
    anchors: list[str] = field(default_factory=list)
    commercial: list[str] = field(default_factory=list)
    governance: list[str] = field(default_factory=list)


def any_word(text: Column, words: list[str]) -> Column:
    """Whether a word (a pattern) stands in a text. Where all are plain words, texts that hold none as a string never reach the pattern."""
    if not words:
        return F.lit(False)
    found = text.rlike(r"(?:^|[^a-z0-9])(?:" + "|".join(words) + r")(?:[^a-z0-9]|$)")
    if all(re.fullmatch(r"[A-Za-z0-9 ]+", w) for w in words):
        held = reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
        return held & found
    return found


def rule_rank(df: DataFrame) -> DataFrame:
    """Category from tags in a fixed order; priority, impact and sentiment from urgency and band."""
    category = F.lit("none")
    for tag, name in reversed(TAG_CATEGORY):
        category = F.when(F.array_contains("tags", tag), name).otherwise(category)
    return df.withColumns({
        "category": category,
        "priority": F.when(F.col("urgent"), 1).when(F.col("band") == "AUTO_KEEP", 2).otherwise(3),
        "impact": F.when(F.col("urgent"), 8).when(F.col("band") == "AUTO_KEEP", 6).otherwise(4),
        "sentiment": F.when(F.col("urgent"), "negative").otherwise("neutral"),
    })


OWN_TAGS = ("constituency", "district", "portfolio")


def names_in(text: Column, tags: Column, p: Profile, strict: bool = False) -> Column:
    """Whether a text names the person followed. A generic form counts beside an anchor or a tag of the own places, or always if strict."""
    beside = any_word(text, p.anchors) | F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*(F.lit(t) for t in OWN_TAGS)))
    return any_word(text, p.names) | (any_word(text, p.generic) if strict else any_word(text, p.generic) & beside)


def guard(df: DataFrame, p: Profile) -> DataFrame:
    """Re-files what the item can't support; adds `guard`, the rule that fired (first match only).

    Needs category, tags, title_norm and text_norm (normalised headline and whole text). With a column reason, the rule is
    added to it; with takeaways, notes that name the person where the text doesn't are thrown away (notes_note says so).
    """
    text, head, cat, tags = F.col("text_norm"), F.col("title_norm"), F.col("category"), F.coalesce("tags", F.array().cast("array<string>"))
    # Columns of their own, so that a text meets each pattern once, however often the rules ask.
    asked = {
        "guard_named": names_in(text, tags, p), "guard_inside": any_word(head, p.constituency_places), "guard_outside": any_word(head, p.outside_places), "guard_local": any_word(text, p.constituency_places),
        "guard_there": any_word(text, p.district_places), "guard_portfolio": any_word(text, p.portfolio), "guard_commercial": any_word(text, p.commercial) & ~any_word(text, p.governance),
    }
    named, inside, outside, local, there, portfolio, commercial = (F.col(c) for c in asked)
    tagged = lambda t: F.array_contains(tags, t)
    anchored = F.arrays_overlap(tags, F.array(*(F.lit(t) for t in OWN_TAGS))) | named | local | there | portfolio
    evidence = {"mention": named, "constituency": inside | (tagged("constituency") | local) & ~outside, "district": tagged("district") | there, "portfolio": tagged("portfolio") | portfolio, "political": tagged("party") & anchored}

    def refile(exclude: str) -> Column:
        out = F.lit("none")
        for name in reversed(list(evidence)):
            if name != exclude:
                out = F.when(evidence[name], name).otherwise(out)
        return out

    headless = (cat == "constituency") & ~inside
    rule = (
        F.when((cat != "none") & commercial, "commercial")
        .when((cat == "mention") & ~named, "not named")
        .when(headless & outside, "outside")
        .when(headless & ~(local | tagged("constituency")), "no place")
        .when(headless, None)
        .when((cat == "political") & ~anchored, "not anchored")
        .when(~cat.isin("mention", "none") & named, "named")
    )
    after = F.when(rule == "commercial", "none").when(rule == "not named", refile("mention")).when(rule.isin("outside", "no place"), refile("constituency")).when(rule == "not anchored", refile("political")).when(rule == "named", "mention").otherwise(cat)
    out = {"guard": rule, "category": after}
    if "reason" in df.columns:
        out["reason"] = F.when(rule.isNotNull(), F.substring(F.concat(F.coalesce("reason", F.lit("")), F.lit(" [guard: "), rule, F.lit(" -> "), after, F.lit("]")), 1, 240)).otherwise(F.col("reason"))
    if "takeaways" in df.columns:
        tainted = ~named & F.coalesce(names_in(F.lower(F.array_join("takeaways", " \n ")), tags, p, strict=True), F.lit(False))
        out |= {"takeaways": F.when(tainted, F.array().cast("array<string>")).otherwise(F.col("takeaways")), "notes_note": F.when(tainted, "notes named another"), "guard": F.coalesce(rule, F.when(tainted, "notes"))}
    return df.withColumns(asked).withColumns(out).drop(*asked)


def place_manual(asked: Column, verdict: Column, rules: Column) -> Column:
    """Asked category, else the verdict's, else the rules', else added."""
    ok = lambda c: F.when(c.isin([x for x in CATEGORIES if x != "none"]), c)
    return F.coalesce(ok(asked), ok(verdict), ok(rules), F.lit("added"))


def checked_verdict(df: DataFrame) -> DataFrame:
    """External verdicts made safe: known names only, numbers clamped, notes cut to five of 200 characters."""
    return df.withColumns({
        "category": F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise("none"),
        "priority": F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(priority as int)"), F.lit(3)))),
        "impact": F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(impact as int)"), F.lit(1)))),
        "sentiment": F.when(F.col("sentiment").isin(SENTIMENTS), F.col("sentiment")).otherwise("neutral"),
        "takeaways": F.slice(F.filter(F.transform(F.coalesce("takeaways", F.array().cast("array<string>")), lambda x: F.substring(F.trim(x), 1, 200)), lambda x: x != ""), 1, 5),
    })

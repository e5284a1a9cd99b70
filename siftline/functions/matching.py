"""Vocabulary matching, weighted scoring and urgency.

A vocabulary is a small table of terms with a tier, a weight, a group and a role. A term
is one lookaround pattern that Spark's and Python's engines read alike, so whether it
occurs is a native expression. Where it occurs (for masking, buried hits and nearness) is
worked out in a pandas function, which gets only the rows in which something occurs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the tiers, bands, and distances in characters.
TIERS = {"constituency": 3, "district": 3, "area": 1, "civic": 2, "crime": 2, "portfolio": 1, "party": 1, "collision": -4, "penalty": -3, "veto": 0, "exclude": 0}
PLACES, URGENT_PLACES, CONTEXT = ("constituency", "district", "area"), ("constituency", "district"), ("civic", "crime")
BANDS = {"AUTO_KEEP": 7, "AI": 2, "KEYWORD_KEEP": 4}
PROXIMITY, LEDE, COLLISION_WINDOW, NEAR_WINDOW = 160, 400, 40, 40
BODY_CHARS, DESCRIPTION_CHARS = 1200, 400
STRONG, NEAR_WEIGHT, MOST_TERMS, EXCERPT = 3, 2, 14, 300

# Endings of Tamil words. A term that ends so keeps its stem if three letters stay; an open stem takes any continuation.
ENDINGS = [("ம்", False), ("்", True), ("ு", True)]
FRONT_VOWELS = "ிீெேை"
GLIDE_AFTER_FRONT, GLIDE = "ய", "வ"
PLURALS = ["கள", "க்கள"]
HARD_CONSONANTS = "கசதப"
DATIVE = "க்கு"
SIGN = "்"

FOREIGN_SCRIPT = r"[ऀ-ॿఀ-౿ಀ-೿ഀ-ൿ]"
HASHTAG = r"#[\w஀-௿]+"
HIDDEN = str.maketrans("", "", "​‌‍﻿")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

Span = tuple[int, int]


def base_letters(text: str) -> int:
    """Letters of scripts without case (category Lo)."""
    return sum(unicodedata.category(c) == "Lo" for c in text)


def stem(word: str) -> tuple[str, bool]:
    """The part of a word that its case forms share, and whether anything may follow it."""
    for ending, is_open in ENDINGS:
        rest = word.removesuffix(ending)
        if rest != word and base_letters(rest) >= 3:
            return rest, is_open
    return word, False


@dataclass(frozen=True)
class Term:
    text: str
    tier: str
    weight: int
    group: str = ""
    role: str = "include"

    @cached_property
    def pattern(self) -> str:
        """Words of ASCII end at word borders, a last * takes the rest of the word; others may begin anywhere, see the ends below."""
        body = self.text.rstrip("*").strip()
        if body.isascii():
            return rf"(?<![a-z0-9]){quoted(body)}{'[a-z0-9]*' if self.text.endswith('*') else ''}(?![a-z0-9])"
        body, is_open = stem(body)
        if is_open:
            return quoted(body)
        if base_letters(body) >= 3:
            return rf"{quoted(body)}(?!\p{{M}})"
        # A short word ends there, or goes on with what its own forms add: a glide, the plural, a doubled consonant, the dative.
        over = r"(?![\p{L}\p{M}])"
        glide = GLIDE_AFTER_FRONT if body[-1:] and body[-1] in FRONT_VOWELS else GLIDE
        return rf"{quoted(body)}(?:{over}|(?={glide}|{'|'.join(PLURALS)}|[{HARD_CONSONANTS}]{SIGN}{over}|{DATIVE}{over}))"

    @cached_property
    def compiled(self) -> regex.Pattern:
        return regex.compile(self.pattern)

    def spans(self, text: str) -> list[Span]:
        if not self.text.rstrip("*").strip():
            return []
        return [m.span() for m in self.compiled.finditer(text, overlapped=not self.text.isascii())]


def quoted(text: str) -> str:
    """For both engines' patterns."""
    return "".join(c if c.isalnum() or ord(c) > 127 or c == " " else f"\\{c}" for c in text)


def near_pattern(word: str, name: str, far: int = NEAR_WINDOW) -> str:
    """A word pattern and a name pattern within so many characters of a sentence, in either order."""
    return rf"(?:{word})[^.\n]{{0,{far}}}(?:{name})|(?:{name})[^.\n]{{0,{far}}}(?:{word})"


class Hit(NamedTuple):
    term: Term
    spans: list[Span]


@dataclass
class Vocabulary:
    """Terms, and patterns of the person followed: the own name in full, other office holders' titles, word and name that make a mention."""

    terms: list[Term]
    named: str = ""
    titles: str = ""
    mention: tuple[str, str] | None = None
    labels: dict[str, str] = field(default_factory=dict)  # of place tiers, for alerts

    @classmethod
    def of(cls, rows: list[dict], **more) -> Vocabulary:
        weight = lambda r: int(r["weight"]) if r.get("weight") not in (None, "") else TIERS[r["tier"]]
        return cls([Term(r["term"].strip().lower(), r["tier"], weight(r), r.get("group") or r["term"].strip().lower(), r.get("role") or "include") for r in rows], **more)

    @property
    def counted(self) -> list[Term]:
        return [t for t in self.terms if t.role != "exclude" and t.tier != "exclude"]

    def tier(self, *names: str) -> list[Term]:
        return [t for t in self.counted if t.tier in names]

    def any_pattern(self) -> str:
        """Something of the vocabulary, or of its patterns, may be in a text; what has none of it scores nothing."""
        near = [self.mention[0]] if self.mention else []
        return "|".join([t.pattern for t in self.counted] + near) or "(?!)"

    def masked(self, text: str) -> str:
        """Excluded phrases blanked, length kept."""
        for t in self.terms:
            if t.role == "exclude" or t.tier == "exclude":
                for s, e in t.spans(text):
                    text = f"{text[:s]}{' ' * (e - s)}{text[e:]}"
        return text

    def hits(self, text: str) -> dict[str, list[Hit]]:
        """Hits by tier in the vocabulary's order, without those inside a longer hit of the tier that adds no white space."""
        found: dict[str, list[Hit]] = {}
        for t in self.counted:
            if spans := t.spans(text):
                found.setdefault(t.tier, []).append(Hit(t, spans))
        out = {}
        for tier, own in found.items():
            every = {s for h in own for s in h.spans}
            alone = lambda s: not any(buries(text, x, s) for x in every)  # noqa: E731, B023
            kept = [Hit(h.term, spans) for h in own if (spans := [s for s in h.spans if alone(s)])]
            if kept:
                out[tier] = kept
        return out


def buries(text: str, outer: Span, inner: Span) -> bool:
    around = outer[0] <= inner[0] and inner[1] <= outer[1] and outer != inner
    return around and not regex.search(r"\s", text[outer[0] : inner[0]] + text[inner[1] : outer[1]])


def gap(a: Span, b: Span) -> int:
    """Characters between two spans; 0 if they touch or overlap."""
    return max(0, max(a[0], b[0]) - min(a[1], b[1]))


def matched(text: str | None) -> str:
    """The normal form for matching (see functions.text.norm_match), composed."""
    text = unicodedata.normalize("NFC", text or "").translate(HIDDEN)
    return regex.sub(r"\s+", " ", text).translate(LOWER).strip()


def plain(text: str | None) -> str:
    """Tags and urls out."""
    return regex.sub(r"https?://\S+", " ", regex.sub(r"<[^>]+>", " ", text or ""))


class TierRule(NamedTuple):
    """What the hits of some tiers add: the largest weight, counted with sign, and the terms that are shown for it."""

    tiers: tuple[str, ...]
    sign: int
    shown: int  # terms; 0: only the one that counts
    mark: str = ""
    counts: Callable[[dict], bool] = lambda facts: True
    shows: Callable[[dict], bool] = lambda facts: True


RULES = {
    "place": TierRule(PLACES, 1, 3),
    "context": TierRule(CONTEXT, 1, 4, "", lambda f: f["placed"], lambda f: f["placed"]),
    "portfolio": TierRule(("portfolio",), 1, 0),
    "mention": TierRule((), 1, 0),
    "party": TierRule(("party",), 1, 0),
    "penalty": TierRule(("penalty",), -1, 2, "-"),
    "collision": TierRule(("collision",), -1, 2, "!", lambda f: not f["strong"] and not f["named"]),
}
TAGGED = ("portfolio", "party")


def facts_of(v: Vocabulary, text: str, title: str | None, hits: dict[str, list[Hit]]) -> dict:
    """What the rules ask about a text."""
    spoken = regex.sub(r"(?<![a-z0-9])([a-z])\.\s?", r"\1 ", text)  # initials without their dots
    strong = any(h.term.weight >= STRONG for h in hits.get("constituency", []))
    named = bool(v.named and regex.search(v.named, text))
    offices = [m.span() for m in regex.finditer(v.titles, text)] if v.titles and not named else []
    beside = next((h.term.text for h in hits.get("collision", []) if any(gap(s, o) <= COLLISION_WINDOW for s in h.spans for o in offices)), None)
    vetoes = [f"collision:{beside}"] if beside else []
    vetoes += [f"veto:{h.term.text}" for h in hits.get("veto", [])[:1]]
    vetoes += ["foreign-script"] if not strong and regex.search(FOREIGN_SCRIPT, title or "") else []
    return {
        "placed": any(k in hits for k in PLACES), "strong": strong, "named": named, "veto": vetoes[0] if vetoes else None,
        "mention": bool(v.mention and regex.search(near_pattern(*v.mention), spoken)),
    }


def band_of(score: int, veto: str | None, has_ai: bool) -> str:
    if veto or score < BANDS["AI"]:
        return "DROP"
    if score >= BANDS["AUTO_KEEP"]:
        return "AUTO_KEEP"
    return "AI" if has_ai else "KEYWORD_KEEP" if score >= BANDS["KEYWORD_KEEP"] else "DROP"


def score_item(v: Vocabulary, title: str | None, description: str | None, body: str | None, has_ai: bool = True) -> dict:
    """Score, band, matched terms, tags and veto of one item."""
    text = v.masked(matched(f"{title or ''} — {plain(description)[:DESCRIPTION_CHARS]} — {(body or '')[:BODY_CHARS]}"))
    hits = v.hits(text)
    facts = facts_of(v, text, title, hits)
    score, terms, tags = 0, [], []
    for name, rule in RULES.items():
        if name == "mention":
            if facts["mention"]:
                score += NEAR_WEIGHT
                terms.append("mention")
                tags.append("mention")
            continue
        own = [h.term for k in rule.tiers for h in hits.get(k, [])]
        if not own:
            continue
        best = max(own, key=lambda t: abs(t.weight) if rule.sign < 0 else t.weight)  # noqa: B023
        if rule.counts(facts):
            score += abs(best.weight) * rule.sign if rule.sign < 0 else best.weight
        if rule.shows(facts):
            ranked = sorted(own, key=lambda t: -t.weight) if name == "place" else own
            terms += [rule.mark + t.text for t in (ranked[: rule.shown] if rule.shown else [best])]
        if name == "place":
            tags += sorted({t.tier for t in own})
        elif name in TAGGED:
            tags.append(name)
    if facts["veto"]:
        terms.append(f"✖{facts['veto']}")
    return {"score": score, "band": band_of(score, facts["veto"], has_ai), "terms": list(dict.fromkeys(terms))[:MOST_TERMS], "tags": list(dict.fromkeys(tags)), "veto": facts["veto"]}


def excerpt(text: str, span: Span | None, width: int = EXCERPT) -> str:
    """About `width` characters around a span, or the beginning; whole words, no letter parted from its marks, dots where it goes on."""
    a, b = span or (0, 0)
    pad = max(40, (width - (b - a)) // 2) if span else width
    lo, hi = max(0, a - pad), min(len(text), b + pad)
    if lo:  # from the first whole word on
        lo = next((m.end() for m in regex.finditer(r"\s", text, pos=lo, endpos=a)), lo)
        while lo and unicodedata.category(text[lo]).startswith("M"):
            lo -= 1
    if hi < len(text):
        hi = max((m.start() for m in regex.finditer(r"\s", text, pos=max(b, 1), endpos=hi)), default=hi)
        while hi < len(text) and unicodedata.category(text[hi]).startswith("M"):
            hi += 1
    return ("…" if lo else "") + regex.sub(r"\s+", " ", text[lo:hi]).strip() + ("…" if hi < len(text) else "")


def urgent_item(v: Vocabulary, title: str | None, description: str | None, body: str | None) -> dict | None:
    """Zone, groups, target, anchors, triggers and excerpt if a place and an urgent term stand together; None otherwise.

    In turn: both in the title; place in the title and term in the first LEDE characters of
    the text; the other way round; both in the text, at most PROXIMITY characters apart.
    """
    raw = regex.sub(r"https?://\S+", " ", body) if (body or "").strip() else plain(description)
    zone = v.masked(matched(regex.sub(HASHTAG, " ", raw)))
    head = v.masked(matched(title))

    def split(text: str) -> tuple[list[Hit], list[Hit]]:
        hits = v.hits(text)
        return [h for k in URGENT_PLACES for h in hits.get(k, [])], [h for k in CONTEXT for h in hits.get(k, []) if h.term.role == "urgent"]

    def lede(hits: list[Hit]) -> list[Hit]:
        return [Hit(h.term, spans) for h in hits if (spans := [s for s in h.spans if s[1] <= LEDE])]

    (head_places, head_terms), (places, terms) = split(head), split(zone)
    first = lambda hits: min((s for h in hits for s in h.spans), default=None)
    ways = [("title", head_places, head_terms, None), ("title+lede", head_places, lede(terms), first(lede(terms))), ("lede+title", lede(places), head_terms, first(lede(places)))]
    chosen = next((w for w in ways if w[1] and w[2]), None)
    if chosen is None:
        pairs = [(gap(a, b), p.term, t.term, (min(a[0], b[0]), max(a[1], b[1]))) for p in places for t in terms for a in p.spans for b in t.spans]
        near = min(pairs, key=lambda x: x[0], default=None)
        if near is None or near[0] > PROXIMITY:
            return None
        chosen = ("body", [Hit(near[1], [])], [Hit(near[2], [])], near[3])
    where, anchors, triggers, span = chosen
    top = max((h.term for h in anchors), key=lambda t: (t.tier == "constituency", t.weight))
    label = lambda hits: list(dict.fromkeys(h.term.text.rstrip("*").strip() for h in hits))
    return {"zone": where, "groups": sorted({(h.term.group or "urgent").lower() for h in triggers}), "target": v.labels.get(top.tier, top.tier), "anchors": label(anchors), "triggers": label(triggers), "excerpt": excerpt(zone, span)}


def place_ids(v: Vocabulary, labels: list[str]) -> list[str]:
    """One identity per place: spellings in a group that is named after a place are that place, others stand alone."""
    anchors = v.tier(*URGENT_PLACES)
    names: dict[str, set[str]] = {}
    for t in anchors:
        names.setdefault(matched(t.group), set()).add(matched(t.text.rstrip("*")))
    own = {matched(t.text.rstrip("*")): f"{t.tier}:{matched(t.group) if matched(t.group) in names[matched(t.group)] else matched(t.text.rstrip('*'))}" for t in anchors}
    return sorted({own.get(matched(x), matched(x)) for x in labels})


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def score_items(df: DataFrame, v: Vocabulary, has_ai: bool = True) -> DataFrame:
    """Adds `scored` (struct). A row that fails gets band ERROR instead of failing the job; rows without any term or foreign script never reach Python's rules."""
    empty = {"score": 0, "band": "DROP", "terms": [], "tags": [], "veto": None}

    @F.pandas_udf("score int, band string, terms array<string>, tags array<string>, veto string")
    def run(asked: pd.Series, title: pd.Series, description: pd.Series, body: pd.Series) -> pd.DataFrame:
        def one(on: bool, *parts: str | None) -> dict:
            try:
                return score_item(v, *parts, has_ai) if on else empty
            except Exception as e:  # one bad row must not stop the others
                return {**empty, "band": "ERROR", "veto": str(e)[:200]}

        return pd.DataFrame([one(*x) for x in zip(asked, title, description, body, strict=True)], columns=list(empty))

    title, description, body = (_column(df, c) for c in ("title", "description", "body"))
    body = F.substring(body, 1, BODY_CHARS)
    asked = maybe(v, title, description, body) | F.coalesce(title.rlike(FOREIGN_SCRIPT), F.lit(False))
    none = lambda c: F.when(asked, c)
    return df.withColumn("scored", run(asked, none(title), none(description), none(body)))


def maybe(v: Vocabulary, *parts: Column) -> Column:
    """Whether something of the vocabulary may be in a text; hidden marks and odd white space, which only Python's form takes out, count as maybe. A term's words may stand on two lines."""
    text = F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), r"[\s\x0B\x1C-\x1F\x{0085}\p{Z}]+", " ")
    return text.rlike(v.any_pattern()) | text.rlike(r"[​‌‍﻿ \p{M}]")


def urgent_items(df: DataFrame, v: Vocabulary) -> DataFrame:
    """Adds `urgent` (struct, its zone null where nothing is urgent, ERROR where a row fails)."""
    none = {"zone": None, "groups": None, "target": None, "anchors": None, "triggers": None, "excerpt": None}
    near = Vocabulary(v.tier(*URGENT_PLACES)), Vocabulary([t for t in v.tier(*CONTEXT) if t.role == "urgent"])

    @F.pandas_udf("zone string, groups array<string>, target string, anchors array<string>, triggers array<string>, excerpt string")
    def run(asked: pd.Series, title: pd.Series, description: pd.Series, body: pd.Series) -> pd.DataFrame:
        def one(on: bool, *parts: str | None) -> dict:
            try:
                return on and urgent_item(v, *parts) or none
            except Exception as e:  # one bad row must not stop the others
                return {**none, "zone": "ERROR", "excerpt": str(e)[:200]}

        return pd.DataFrame([one(*x) for x in zip(asked, title, description, body, strict=True)], columns=list(none))

    title, description, body = (_column(df, c) for c in ("title", "description", "body"))
    asked = maybe(near[0], title, description, body) & maybe(near[1], title, description, body)
    only = lambda c: F.when(asked, c)
    return df.withColumn("urgent", run(asked, only(title), only(description), only(body)))


def term_counts(df: DataFrame, text: str, v: Vocabulary) -> DataFrame:
    """Adds `counts`: per term how often it stands in the text, without hits buried in a longer one of its tier."""

    @F.pandas_udf("map<string,int>")
    def run(texts: pd.Series) -> pd.Series:
        each = lambda t: {h.term.text: len(h.spans) for own in v.hits(v.masked(matched(t))).values() for h in own} if t else {}
        return texts.map(each)

    return df.withColumn("counts", run(F.when(maybe(v, F.col(text)), F.col(text))))


def native_score(text: Column, v: Vocabulary, has_ai: bool = True, hits: Column | None = None) -> dict[str, Column]:
    """Score and band of a normalised, masked text by occurrence only; the part of score_item that needs no positions. Context counts once, by its largest weight.

    hits: the numbers of the counted terms that occur, as automaton.term_numbers finds them in one pass; without it each weight is a pattern.
    """

    def largest(*tiers: str) -> Column:
        """The largest weight of the tiers' terms that occur; null if none does. Terms of one weight are one pattern."""
        if hits is not None:
            own = F.array(*(F.lit(abs(t.weight) if t.tier in tiers else None).cast("int") for t in v.counted)).cast("array<int>")
            return F.array_max(F.transform(hits, lambda k: F.get(own, k)))
        by_weight: dict[int, list[str]] = {}
        for t in v.tier(*tiers):
            by_weight.setdefault(abs(t.weight), []).append(t.pattern)
        out = F.lit(None).cast("int")
        for weight in sorted(by_weight):
            out = F.when(text.rlike("|".join(by_weight[weight])), F.lit(weight)).otherwise(out)
        return out

    zero = F.lit(0)
    place = largest(*PLACES)
    strong = F.coalesce(largest("constituency") >= STRONG, F.lit(False)) | (text.rlike(v.named) if v.named else F.lit(False))
    score = F.coalesce(place, zero) + F.when(place.isNotNull(), F.coalesce(largest(*CONTEXT), zero)).otherwise(0)
    for tier in ("portfolio", "party"):
        score = score + F.coalesce(largest(tier), zero)
    score = score - F.coalesce(largest("penalty"), zero) - F.when(strong, 0).otherwise(F.coalesce(largest("collision"), zero))
    if v.mention:
        score = score + F.when(text.rlike(near_pattern(*v.mention)), NEAR_WEIGHT).otherwise(0)
    veto = largest("veto").isNotNull()
    middle = F.when(score >= BANDS["AI"], "AI") if has_ai else F.when(score >= BANDS["KEYWORD_KEEP"], "KEYWORD_KEEP")
    band = F.when(veto, "DROP").when(score >= BANDS["AUTO_KEEP"], "AUTO_KEEP").otherwise(F.coalesce(middle, F.lit("DROP")))
    return {"score": score.cast("int"), "band": band}

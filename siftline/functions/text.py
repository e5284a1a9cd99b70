"""Text, title, hash and similarity expressions, all on the JVM unless said otherwise."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits and underscore, and one Indic block whose vowel signs \w lacks.
WORD_CLASS = r"[^\p{L}\p{N}_\x{0B80}-\x{0BFF}]+"
JOINERS = ["‌", "‍"]
HIDDEN = ["​", *JOINERS, "﻿"]


def without(c: Column, marks: list[str]) -> Column:
    for m in marks:
        c = F.replace(c, F.lit(m), F.lit(""))
    return c


def nfc(c: Column) -> Column:
    """Unicode composition, in Arrow batches; Spark has no function for it. Rows without a character from U+0300 on are composed as they are and stay out of Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)

    return F.coalesce(run(F.when(c.rlike(r"[^\x00-\x{02FF}]"), c)), c)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def norm_match(c: Column) -> Column:
    """For term matching: composed, hidden marks out, ASCII lower case only, white space to single spaces."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.trim(F.regexp_replace(F.translate(without(nfc(c), HIDDEN), upper, lower), r"\s+", " "))


def sim_norm(c: Column) -> Column:
    """For similarity: composed, joiners out, full lower case, anything but word characters to one space."""
    return F.trim(F.regexp_replace(F.lower(without(nfc(c), JOINERS)), WORD_CLASS, " "))


def grams(c: Column, n: int = 4) -> Column:
    """The set of n-character strings; empty for shorter texts. The text is cut into characters once: substring would count from its start for each."""
    none = F.array().cast("array<string>")

    def cut(s: Column) -> Column:
        every = bound(F.split(s, ""), lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat(*(F.get(x, i + k) for k in range(n)))))
        return F.when(F.length(s) >= n, F.array_distinct(every)).otherwise(none)

    return F.coalesce(bound(c, cut), none)


def text_slices(texts: pa.Array, most_bytes: int = 1 << 22) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch in lists of bounded bytes (or one text), so that what is made of them at once is bounded."""
    lo, held, size = 0, 0, pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for hi, n in enumerate(size):
        if hi > lo and held + n > most_bytes:
            yield texts[lo:hi].to_pylist()
            lo, held = hi, 0
        held += n
    if lo < len(size):
        yield texts[lo:].to_pylist()


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's n-character strings: one pass over code points instead of a substring scan a position."""
    base = np.uint64(0x9E3779B97F4A7C15)
    code = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(code) < n:
        return np.zeros(0, np.int64)
    out = code[: len(code) - n + 1]
    for k in range(1, n):
        out = out * base + code[k : len(code) - n + 1 + k]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29))).view(np.int64)


def gram_hashes(c: Column, n: int = 4) -> Column:
    """The set of n-character strings as hashes, in Arrow batches."""

    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for some in text_slices(texts):
            sets = [gram_set(t, n) for t in some]
            off = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            parts.append(pa.ListArray.from_arrays(off, np.concatenate(sets)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return run(c)


def gram_counts(c: Column, n: int = 4) -> Column:
    """How many different n-character strings a text has; only the number leaves the task's Python."""

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([len(gram_set(t, n)) for some in text_slices(texts) for t in some], pa.int32())

    return run(c)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / (F.size(a) + F.size(b) - same)).otherwise(0.0)


def strip_html(c: Column) -> Column:
    """Tags to spaces, character references decoded, white space collapsed."""
    c = unescape(F.regexp_replace(c, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))


def unescape(c: Column) -> Column:
    """All character references of HTML decoded, in Arrow batches; rows without an ampersand stay out of Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html.unescape(x) if x is not None else None)

    return F.coalesce(run(F.when(F.contains(c, F.lit("&")), c)), c)


def meta_content(page: Column, names: str) -> Column:
    """The content of the first meta tag of these names (a pattern), whichever attribute comes first; empty if there is none."""
    name = rf"""(?:property|name)\s*=\s*["'](?:{names})["']"""
    forms = [rf"""(?is)<meta\b[^>]*?{name}[^>]*?\scontent\s*=\s*(["'])(.*?)\1""", rf"""(?is)<meta\b[^>]*?\scontent\s*=\s*(["'])([^>]*?)\1[^>]*?{name}"""]
    return F.coalesce(*(F.nullif(F.regexp_extract(page, p, 2), F.lit("")) for p in forms), F.lit(""))


def page_title(page: Column, decode: Callable[[Column], Column] = unescape) -> Column:
    """og:title, else the title element; decoded, one line, without a video site's suffix."""
    raw = F.coalesce(F.nullif(meta_content(page, "og:title"), F.lit("")), F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(decode(raw), r"\s+", " ")), r"\s*[-|]\s*YouTube$", ""))


def page_description(page: Column, most: int = 1500) -> Column:
    return F.substring(F.trim(F.regexp_replace(unescape(meta_content(page, "og:description|description")), r"\s+", " ")), 1, most)


def lead_image(page: Column, head: int = 60_000, longest: int = 600) -> Column:
    """The address in og:image (or its secure form) or twitter:image of the page's head; null if none is a usable web address."""
    top = F.substring(page, 1, head)
    found = [unescape(F.trim(meta_content(top, names))) for names in ("og:image|og:image:secure_url", "twitter:image")]
    return F.coalesce(*(F.when(F.startswith(f, F.lit("http")) & (F.length(f) < longest), f) for f in found))


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+", " ")


def clean_title(title: Column, publisher: Column | None = None) -> Column:
    """Without a trailing " - publisher", or else a short trailing " - tail" behind position 20."""
    t = F.trim(title)
    at = F.length(t) - F.length(F.substring_index(t, " - ", -1)) - 3
    short = F.when((at > 20) & (F.length(t) - at < 45), F.substring(t, F.lit(1), at)).otherwise(t)
    if publisher is None:
        return F.trim(short)
    tail = F.concat(F.lit(" - "), publisher)
    return F.trim(F.when(publisher.isNotNull() & F.endswith(t, tail), F.substring(t, F.lit(1), F.length(t) - F.length(tail))).otherwise(short))


def norm_title(title: Column, publisher: Column | None = None) -> Column:
    return F.trim(F.regexp_replace(norm_match(clean_title(title, publisher)), WORD_CLASS, " "))


def cut(c: Column, n: int) -> Column:
    """At most n characters, never within a base letter's marks; at the last space beyond 60 % if there is one; then an ellipsis."""
    head = F.regexp_replace(F.substring(c, 1, n + 1), r".\p{M}*$", "")
    space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    short = F.when(space > int(0.6 * n), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(short), F.lit("…")))


def snippet(status: Column, body: Column, description: Column, n: int = 220) -> Column:
    """The body where it was extracted, else the cleaned description."""
    return cut(F.trim(F.regexp_replace(F.when(status.isin("OK", "THIN"), body).otherwise(strip_html(description)), r"\s+", " ")), n)


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 24)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def escape_html(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def escape_attribute(c: Column) -> Column:
    """For a quoted attribute of markup."""
    return F.replace(escape_html(c), F.lit('"'), F.lit("&quot;"))


def plain_of_markup(c: Column) -> Column:
    """The inverse, for a channel that takes no markup: a link's address after its text in brackets, tags out, references decoded (ampersand last)."""
    c = F.regexp_replace(c, r'(?is)<a\s+href="([^"]*)">(.*?)</a>', "$2 ($1)")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for raw, name in (('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(name), F.lit(raw))
    return c


def stem_en(word: Column) -> Column:
    """Plural and participle endings off, where four letters stay."""
    kept = lambda k: F.substring(word, F.lit(1), F.length(word) - k)
    out = F.when(F.endswith(word, F.lit("ies")) & (F.length(word) > 4), F.concat(kept(3), F.lit("y")))
    for suffix in ("ing", "es", "ed", "s"):
        out = out.when(F.endswith(word, F.lit(suffix)) & (F.length(word) - len(suffix) >= 4), kept(len(suffix)))
    return out.otherwise(word)


def core_terms(title: Column, common: list[str]) -> Column:
    """Identifying words of a headline: four letters or more, or three capitals; minus common words; never numbers."""
    words = F.regexp_extract_all(title, F.lit(r"(\p{L}+)"), F.lit(1))
    good = F.filter(words, lambda w: (F.length(w) >= 4) | w.rlike("^[A-Z]{3}$"))
    return F.array_except(F.array_distinct(F.transform(good, F.lower)), F.array(*(F.lit(x) for x in common)).cast("array<string>"))


def shared_words(a: Column, b: Column, most_more: int = 5) -> Column:
    """How many words of a (stems) are in b: equal ones, and words of scripts without case of which one is the other with a short ending."""

    def alike(x: Column, y: Column) -> Column:
        far = F.abs(F.length(x) - F.length(y)) <= most_more
        return far & (F.startswith(x, y) | F.startswith(y, x))

    caseless = lambda w: w.rlike(r"\p{Lo}")
    return F.size(F.filter(a, lambda x: F.array_contains(b, x) | caseless(x) & F.exists(F.filter(b, caseless), lambda y: alike(x, y))))


def places(c: Column, groups: dict[str, list[str]], stem: Callable[[str], tuple[str, bool]] = lambda w: (w, False)) -> Column:
    """The place groups that a text names, in the table's order: a group is named if one of its words, or the stem of one, is in the text."""
    low = F.lower(c)

    def named(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(stem(w.lower())[0]))
        return out

    return F.array_compact(F.array(*(F.when(named(words), F.lit(group)) for group, words in groups.items())))


def set_hash(ids: Column) -> Column:
    """A content hash of a set of ids (an aggregate): the count and the sum of the distinct ids' hashes, so that no row holds them all."""
    each = ids.cast("string")
    return F.sha1(F.concat_ws(":", F.count_distinct(each).cast("string"), F.sum_distinct(F.conv(F.substring(F.sha1(each), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")))

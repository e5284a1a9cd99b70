"""The library's functions under SQL names, for spark.sql.

Each is an Arrow function on whole batches; parse_links is a table function. Native forms of
most of them are in functions.text and functions.urls, for use from Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftline.functions import matching

LINK = regex.compile(r"https?://[^\s<>\"']+|\bitem:\d+")
WORD_CLASS = regex.compile(r"[^\w\p{M}]+")


def sim_form(text: str) -> str:
    return WORD_CLASS.sub(" ", text.translate(matching.HIDDEN).lower()).strip()


def gram_set(text: str | None, n: int = 4) -> set[str]:
    form = sim_form(text or "")
    return {form[k : k + n] for k in range(len(form) - n + 1)}


def same_share(a: str | None, b: str | None) -> float:
    x, y = gram_set(a), gram_set(b)
    return len(x & y) / len(x | y) if x and y else 0.0


class ParseLinks:
    """Every link or story number of a free text in order: place, link, and the first listed word (a section, say) of what stands before the next one."""

    def eval(self, text: str | None, words: str | None) -> Iterator[tuple[int, str, str | None]]:
        listed = {w.strip().lower() for w in (words or "").split(",") if w.strip()}
        found = list(LINK.finditer(text or ""))
        for k, m in enumerate(found):
            after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
            word = next((w for w in regex.findall(r"[\p{L}\p{M}\p{N}_]+", after.lower()) if w in listed), None)
            yield k, m.group().rstrip(".,;)"), word


def register(spark: SparkSession, vocabulary: matching.Vocabulary) -> None:
    """norm_match, ngrams, jaccard_sim, term_score, urgent_zone and parse_links as SQL functions; the scores are by this vocabulary."""

    @F.pandas_udf("string")
    def norm_match(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else matching.matched(t))

    @F.pandas_udf("array<string>")
    def ngrams(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted(gram_set(t)))

    @F.pandas_udf("double")
    def jaccard_sim(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_share(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    @F.pandas_udf("int")
    def term_score(title: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([matching.score_item(vocabulary, t, None, b)["score"] for t, b in zip(title, body, strict=True)], dtype="int32")

    @F.pandas_udf("string")
    def urgent_zone(title: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([(matching.urgent_item(vocabulary, t, None, b) or {"zone": None})["zone"] for t, b in zip(title, body, strict=True)], dtype=object)

    for f in (norm_match, ngrams, jaccard_sim, term_score, urgent_zone):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("parse_links", F.udtf(ParseLinks, returnType="place int, link string, word string"))

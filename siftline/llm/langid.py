"""Language identification with bit-sliced Bloom filters of language bitmasks.

Character n-grams (four characters of spaced scripts, two of others) that are typical of
a language are put into one Bloom filter per language; the filters are stored bit-sliced, as one array whose every slot
is a bitmask of languages, so one lookup (the AND of k slots) returns all
languages that contain an n-gram. A text's votes are the popcounts per language
over its n-grams, corrected for each filter's false-positive rate; the largest
corrected share of matched n-grams decides.

Learning counts n-grams over all training rows, in Spark, with partial counts per
task; what reaches the driver is the kept n-grams, at most `per_language` of each
language (a parameter), so its size has a fixed bound.

Cases: null text and text without a letter are `und` with score 0; texts shorter
than an n-gram are matched with their word-boundary n-grams; ties between
languages go to the first in alphabetical order; rows with a null lang or text are
not learned from, every other value of lang is a language, also one of a single row;
without any training row every text is `und`. Repeated rows
count as often as they occur. Any number of languages works: masks widen in steps
of 64. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table
from .textbytes import LOWER, SPACE, U64, chunks, mix, rolling, tidy

NGRAM, SHORT_NGRAM = 4, 2
FIRST_UNSPACED = 0x0E00  # scripts from here on write words without spaces or letters as syllables
PER_LANGUAGE = 6000
SLOTS = 1 << 20
HASHES = 3
LETTERS = r"\p{L}"

# Bytes that end a word for n-grams: white space, ASCII digits and punctuation.
CUT = SPACE.copy()
CUT[[b for b in range(128) if not chr(b).isalpha()]] = True


def characters(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, code point) of each character of UTF-8 bytes."""
    at = np.flatnonzero((flat & 0xC0) != 0x80)
    code = flat[at].astype(np.uint32)
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        lead, place = code[wide], at[wide]
        more = np.where(lead >= 0xF0, 3, np.where(lead >= 0xE0, 2, 1))
        value = lead & np.array([0, 0x1F, 0x0F, 0x07], np.uint32)[more]
        for k in (1, 2, 3):
            on = more >= k
            value[on] = (value[on] << 6) | (flat[place[on] + k] & 0x3F)
        code[wide] = value
    return at, code


def ngrams(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the character n-grams of words, each word with one blank on both sides.

    N-grams that begin with a character of an unspaced script have SHORT_NGRAM characters, others NGRAM.
    """
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, code = characters(np.where(CUT[flat], np.uint8(32), LOWER[flat]))
    # One blank before and after every row; runs of cut characters become one blank.
    rows = len(off) - 1
    count = np.diff(np.searchsorted(at, off))
    row = np.repeat(np.arange(rows), count)
    wide = np.full(len(code) + 2 * rows, 32, np.uint32)
    wide[np.arange(len(code)) + 2 * row + 1] = code
    row = np.repeat(np.arange(rows), count + 2)
    blank = wide == 32
    keep = np.ones(len(wide), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    wide, row, blank = wide[keep], row[keep], blank[keep]
    own = mix(wide.astype(np.uint64) + U64(0x51ED270B))
    found = []
    for n, sort in ((NGRAM, wide < FIRST_UNSPACED), (SHORT_NGRAM, wide >= FIRST_UNSPACED)):
        h = rolling(own, n)
        first = np.flatnonzero(sort[: len(h)])
        inside = row[first] == row[first + n - 1]
        for k in range(1, n - 1):  # a blank only as first or last character
            inside &= ~blank[first + k]
        first = first[inside]
        found.append((row[first], h[first]))
    if not len(found[1][0]):
        return found[0]
    row, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], h[order]


@dataclass
class LanguageFilters:
    """The bit-sliced filters: slots[(slot, word)] holds the languages' bits."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false_positive: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], slots: int = SLOTS, hashes: int = HASHES) -> LanguageFilters:
        languages = sorted(grams)
        width = max(1, -(-len(languages) // 64))
        table = np.zeros((slots, width), np.uint64)
        for k, name in enumerate(languages):
            for where in cls.places(grams[name].astype(np.uint64), slots, hashes):
                table[where, k // 64] |= U64(1 << (k % 64))
        fill = np.array([((table[:, k // 64] >> U64(k % 64)) & U64(1)).mean() for k in range(len(languages))])
        return cls(languages, table, hashes, fill**hashes)

    @staticmethod
    def places(h: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
        step = mix(h ^ U64(0x5851F42D4C957F2D)) | U64(1)
        for i in range(hashes):
            yield ((h + U64(i) * step) % U64(slots)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The mask of all languages that (seem to) contain each n-gram."""
        out = None
        for where in self.places(h, len(self.slots), self.hashes):
            got = self.slots[where]
            out = got if out is None else out & got
        return out

    def scores(self, row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
        """(rows, languages): share of a row's n-grams in each language, corrected for false positives."""
        n = np.bincount(row, minlength=rows)
        masks = self.lookup(h)
        out = np.zeros((rows, len(self.languages)))
        for k in range(len(self.languages)):
            hit = (masks[:, k // 64] >> U64(k % 64)) & U64(1)
            got = np.bincount(row, weights=hit.astype(float), minlength=rows)
            p = self.false_positive[k]
            out[:, k] = np.clip((got - p * n) / (1 - p), 0, None) / np.maximum(n, 1)
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, rows): in how many rows of a language each n-gram is; counts are combined within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            lang = pd.Series(b.column(0).to_pandas())
            codes, names = pd.factorize(lang)
            for first, flat, off in chunks(b.column(1)):
                row, h = ngrams(flat, off)
                code = codes[first + row]
                for c in np.unique(code):
                    own = code == c
                    pair = _distinct(row[own], h[own])
                    g, n = np.unique(pair, return_counts=True)
                    old = total.get(names[c])
                    if old is not None:
                        both = np.concatenate([old[0], g])
                        g, where = np.unique(both, return_inverse=True)
                        n = np.bincount(where, weights=np.concatenate([old[1], n])).astype(np.int64)
                    total[names[c]] = (g, n)
        for name, (g, n) in total.items():
            for at in range(0, len(g), 65536):
                part = slice(at, at + 65536)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g[part])), pa.array(g[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["lang", "gram", "rows"])

    counted = docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(tidy(run), "lang string, gram long, rows long")
    return counted.groupBy("lang", "gram").agg(F.sum("rows").alias("rows"))


def _distinct(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hashes of distinct (row, hash) pairs."""
    order = np.lexsort((h, row))
    r, g = row[order], h[order]
    new = np.ones(len(g), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return g[new]


def learn(training: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageFilters:
    """Filters of each language's most frequent n-grams (by rows that hold them, ties by hash), however few rows it has."""
    counts = gram_counts(training)
    # The best of each salt first, so that no window holds all n-grams of a language.

    salted = counts.withColumn("salt", F.pmod("gram", F.lit(64)))
    best = salted.withColumn("r", F.row_number().over(W.partitionBy("lang", "salt").orderBy(F.desc("rows"), "gram"))).filter(F.col("r") <= per_language)
    best = best.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("rows"), "gram"))).filter(F.col("r") <= per_language)
    got = best.select("lang", "gram").toPandas()
    return LanguageFilters.build({name: g["gram"].to_numpy(np.int64).view(np.uint64) for name, g in got.groupby("lang")})


def decide(filters: LanguageFilters, texts: pa.Array, letter: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text. The score is the winner's share of the two best languages' votes, times the root of the share of the text that it explains."""
    pred, score = [], []
    for first, flat, off in chunks(texts):
        rows = len(off) - 1
        row, h = ngrams(flat, off)
        if not filters.languages:
            pred += ["und"] * rows
            score += [0.0] * rows
            continue
        s = filters.scores(row, h, rows)
        best = s.argmax(axis=1)
        top = s[np.arange(rows), best]
        rest = np.where(np.arange(s.shape[1])[None, :] == best[:, None], 0, s).max(axis=1)
        sure = np.where(top > 0, top / np.maximum(top + rest, 1e-12), 0) * np.sqrt(np.clip(top, 0, 1))
        has = letter[first : first + rows]
        pred += [filters.languages[k] if ok else "und" for k, ok in zip(best, has, strict=True)]
        score += np.where(has, np.clip(sure, 0, 1), 0.0).tolist()
    return pred, score


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(LETTERS), F.lit(False)).alias("has_letter")


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS masks: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = decide(shared.value, b.column(1), b.column(2).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text", has_letter()).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, filters: LanguageFilters, least_score: float) -> DataFrame:
    """The rows of docs, with all columns, whose text has a language of at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 1
            pred, score = decide(shared.value, b.column("text"), b.column(n).to_numpy(zero_copy_only=False).astype(bool))
            good = pa.array([p != "und" and s >= least_score for p, s in zip(pred, score, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)], b.schema.names[:n]).filter(good)

    own = docs.drop("has_letter")
    return own.select("*", has_letter()).mapInArrow(tidy(run), own.schema)


def op4_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = learn(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, filters).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")

"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector shared by all ordered
thresholds. x marks which of the chosen features a text has: whole words and their
first four and five bytes (inflected forms share them), each hashed to 64 bits. The
output is the expected severity, the most likely grade and P(grade > 0).

Labels only say toxic or not, so grades of toxic rows come from how many of the
words that mark toxic rows they hold: 0 clean, 1, 2, 3 by thirds, or fewer grades where
ties leave fewer different counts. Fitting uses at
most about `fit_rows` labelled rows, chosen by a hash of doc_id (a parameter); feature
counts for it are added up in Spark, and what reaches the driver is bounded by
`features` and `fit_rows`. Every document is scored over its whole text.

Cases: null, empty or unlabelled texts are scored like others (no features: the
base rate); labels with null doc_id or toxic are not used; a doc_id with several
labels counts once for each; repeated rows get equal scores; without usable labels
all severities are 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import CUT
from .shared import stage, table, top_rows
from .textbytes import U64, Words, chunks, mix, tidy

FIT_ROWS = 20_000
FEATURES = 16_384
LEAST_ROWS = 4
GRADES = 4
FILTER = 1 << 22


def text_features(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, its first four and its first five bytes."""
    words = Words(flat, off, space=CUT)
    rows, found = [words.row], [words.hash]
    for n, salt in ((4, 0x1F0A), (5, 0x2F0B)):
        long = words.end - words.start > n
        s = words.start[long]
        rows.append(words.row[long])
        found.append(mix(words.span_hash(s, s + n) ^ U64(salt)))
    return np.concatenate(rows), np.concatenate(found)


def distinct_pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    r, g = row[order], h[order]
    new = np.ones(len(g), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return r[new], g[new]


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, toxic) of about fit_rows labelled rows; the labels that go to every task are bounded by it."""
    usable = labels.filter("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = usable.count()
    share = min(1.0, fit_rows / max(n, 1))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic_rows, clean_rows), combined within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False) > 0
            for first, flat, off in chunks(b.column(0)):
                row, h = distinct_pairs(*text_features(flat, off))
                g, where = np.unique(h, return_inverse=True)
                bad = np.bincount(where, weights=toxic[first + row], minlength=len(g)).astype(np.int64)
                all_ = np.bincount(where, minlength=len(g)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(bad), pa.array(all_ - bad)], ["feature", "toxic_rows", "clean_rows"])

    counted = sample.mapInArrow(tidy(run), "feature long, toxic_rows long, clean_rows long")
    return counted.groupBy("feature").agg(F.sum("toxic_rows").alias("toxic_rows"), F.sum("clean_rows").alias("clean_rows"))


@dataclass
class FeatureTable:
    """Sorted feature hashes with a bitmap in front, so that most words are ruled out by one lookup."""

    keys: np.ndarray

    def __post_init__(self) -> None:
        self.seen = np.zeros(FILTER, bool)
        self.seen[(self.keys % U64(FILTER)).astype(np.int64)] = True

    def find(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, index of feature) of the known features."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = self.seen[(h % U64(FILTER)).astype(np.int64)]
        row, h = row[maybe], h[maybe]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        return distinct_pairs(row[known], at[known])


@dataclass
class OrdinalModel:
    features: FeatureTable
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one fewer than grades
    cut: float = 0.5  # P(grade > 0) from which a text counts as toxic

    def exceed(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES, l1: float = 2e-4, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Proximal adaptive gradient descent on the cumulative-link likelihood with an L1 penalty.

    Weights stay at 0 or above: features are evidence of severity, and a long clean text
    must not outweigh it.

    Thresholds are a first one plus exponentials of gaps, so they stay in order.
    """
    n = max(len(grade), 1)
    w, first, gaps = np.zeros(n_features), 0.0, np.zeros(max(grades - 2, 0))
    share = np.clip(np.array([(grade <= k).mean() if len(grade) else 0.5 for k in range(grades - 1)]), 1e-3, 1 - 1e-3)
    share = np.maximum.accumulate(share + 1e-4 * np.arange(grades - 1))
    start = np.log(share / (1 - share))
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    past_w, past_t, rate = np.full(n_features, 1e-8), np.full(grades - 1, 1e-8), 0.5
    for _ in range(steps):
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = np.bincount(row, weights=w[col], minlength=len(grade))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        hi = 1 / (1 + np.exp(np.clip(z - edges[grade + 1], -50, 50)))
        lo = 1 / (1 + np.exp(np.clip(z - edges[grade], -50, 50)))
        inside = np.maximum(hi - lo, 1e-12)
        dz = (1 - hi - lo) / n
        gw = np.bincount(col, weights=dz[row], minlength=n_features)
        dtheta = np.zeros(grades + 1)
        np.add.at(dtheta, grade + 1, -hi * (1 - hi) / inside / n)
        np.add.at(dtheta, grade, lo * (1 - lo) / inside / n)
        dtheta = dtheta[1:grades]
        back = np.cumsum(dtheta[::-1])[::-1]
        gt = np.concatenate([[back[0]], back[1:] * np.exp(gaps)])
        past_w += gw * gw
        past_t += gt * gt
        step = rate / np.sqrt(past_w)
        w = w - step * gw
        w = np.maximum(w - step * l1, 0)
        move = rate / np.sqrt(past_t) * gt
        first, gaps = first - move[0], np.clip(gaps - move[1:], -4, 3)
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def severity_steps(marks: np.ndarray, of: np.ndarray, steps: int = GRADES - 1) -> np.ndarray:
    """0, 1, 2 by where a row's count stands among the counts `of`: cuts between different counts, as near to equal shares as ties allow.

    No step is empty: fewer different counts give fewer steps.
    """
    values, n = np.unique(of, return_counts=True)
    share = np.cumsum(n) / n.sum()
    cuts: list[float] = []
    for k in range(1, min(steps, len(values))):
        near = int(np.abs(share[:-1] - k / steps).argmin())
        if values[near] not in cuts:
            cuts.append(values[near])
    return sum(((marks > c).astype(np.int64) for c in cuts), np.zeros(len(marks), np.int64))


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability that parts toxic from clean fitted rows best (by F1), midway (in log odds) between the two rows at the border."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + toxic.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = 0
    k = int(f1.argmax())
    odds = np.log(np.clip(p, 1e-12, 1 - 1e-12) / (1 - np.clip(p, 1e-12, 1 - 1e-12)))[order]
    middle = (odds[k] + odds[min(k + 1, len(p) - 1)]) / 2
    return float(np.clip(1 / (1 + np.exp(-middle)), 0.02, 0.5))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> OrdinalModel:
    sample = labelled_sample(docs, labels, fit_rows)
    totals = sample.groupBy().agg(F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") <= 0).alias("good")).first()
    bad, good = totals["bad"] or 0, totals["good"] or 0
    if not bad or not good:
        return OrdinalModel(FeatureTable(np.zeros(0, np.uint64)), np.zeros(0), np.full(GRADES - 1, 50.0))
    p, q = (F.col("toxic_rows") + 0.5) / (bad + 1.0), (F.col("clean_rows") + 0.5) / (good + 1.0)
    odds = F.ln(p / (1.0 + 1e-9 - p)) - F.ln(q / (1.0 + 1e-9 - q))
    certain = odds / F.sqrt(1 / (F.col("toxic_rows") + 0.5) + 1 / (F.col("clean_rows") + 0.5))
    ranked = stage(feature_counts(sample), "features").filter(F.col("toxic_rows") + F.col("clean_rows") >= LEAST_ROWS).withColumn("z", certain)
    top = top_rows(ranked.withColumn("sure", F.abs("z")), "sure", features, "feature").select("feature", "toxic_rows", "clean_rows", "z").toPandas()
    keys = top["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, z = keys[order], top["z"].to_numpy()[order]
    found = FeatureTable(keys)
    marker = (z > 4) & (top["clean_rows"].to_numpy()[order] <= 0.02 * top["toxic_rows"].to_numpy()[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, flat, off in chunks(b.column(0)):
                row, col = found.find(*text_features(flat, off))
                cut = np.searchsorted(row, np.arange(len(off)))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(col, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(first, len(off) - 1), lists], ["toxic", "cols"])

    got = sample.mapInArrow(tidy(run), "toxic int, cols array<int>").toPandas()
    lengths = got["cols"].map(len).to_numpy()
    row = np.repeat(np.arange(len(got)), lengths)
    col = np.concatenate(got["cols"].tolist()).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    toxic = got["toxic"].to_numpy() > 0
    marks = np.bincount(row, weights=marker[col].astype(float), minlength=len(got))
    grade = np.where(toxic, 1 + severity_steps(marks, marks[toxic]), 0)
    weights, thresholds = fit_ordinal(row, col, grade, len(keys), int(grade.max()) + 1)
    used = weights != 0
    model = OrdinalModel(FeatureTable(keys[used]), weights[used], thresholds)
    model.cut = best_cut(model.exceed(np.bincount(row, weights=weights[col], minlength=len(got)))[:, 0], toxic)
    return model


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, text) -> (doc_id, severity, grade, p_toxic, toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            z = np.zeros(len(b))
            for first, flat, off in chunks(b.column(1)):
                row, col = m.features.find(*text_features(flat, off))
                z[first : first + len(off) - 1] = np.bincount(row, weights=m.weights[col], minlength=len(off) - 1)
            over = m.exceed(z)
            each = -np.diff(np.concatenate([np.ones((len(b), 1)), over, np.zeros((len(b), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(over.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0]), pa.array(over[:, 0] >= m.cut)],
                ["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))

"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set of word shingles gives a signature of POSITIONS minhash values of
16 bits. The positions are split into chunks so that, by the pigeonhole principle,
two signatures that differ in at most D positions have a chunk with at most one
difference; the allowed chunk error is enumerated by leaving out each position of
each chunk in turn. So every pair within distance D shares a key. D is set so that
a pair at exactly the least similarity is beyond it with probability under 1e-5.

Equal sets are one vertex. Of the vertices that share a key, one (that with the
most partners) becomes the pivot; vertices around one pivot are compared on their
full sets, in blocks of bounded size, and each block reports a spanning forest of
its links, never all pairs. A group's members that link to the pivot are not
compared among themselves, all others are compared with everyone, so no component
loses a link.

Cases: null and empty texts have an empty set and are linked with nothing, also not
with each other; a text with fewer words than a shingle is one shingle of all its
words; repeated rows are equal sets; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.graph import components

from .shared import might_be_in, stage, table
from .textbytes import U64, Words, chunks, mix, run_starts, tidy

POSITIONS = 64
BLOCK_SHINGLES = 1_000_000
MISS = 1e-5
_RNG = np.random.default_rng(7)
MULTIPLIERS = _RNG.integers(1, 2**63, POSITIONS, dtype=np.uint64) * U64(2) + U64(1)


def distance_bound(similarity: float, miss: float = MISS) -> int:
    """The least D with P(Binomial(POSITIONS, 1 - similarity) > D) < miss."""
    p, tail, d = 1 - similarity, 1.0, -1
    while tail >= miss and d < POSITIONS:
        d += 1
        tail -= math.comb(POSITIONS, d) * p**d * (1 - p) ** (POSITIONS - d)
    return d


def chunk_bounds(distance: int) -> list[tuple[int, int]]:
    """Chunks of positions, so many that `distance` differences leave one with at most one."""
    n = min(POSITIONS // 2, distance // 2 + 1)
    cuts = np.linspace(0, POSITIONS, n + 1).round().astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def shingle_sets(flat: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles, sorted by row and hash."""
    words = Words(flat, off)
    h, rows = words.hash, len(off) - 1
    n = words.count
    place = np.arange(len(h)) - np.repeat(words.first[:-1], n)
    starts = np.flatnonzero(place + k <= np.repeat(n, n))
    out = np.full(len(starts), k, np.uint64)
    for i in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[starts + i])
    row = words.row[starts]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = n[short].astype(np.uint64)
        for i in range(k - 1):
            has = n[short] > i
            whole[has] = mix(whole[has] * U64(0x9E3779B97F4A7C15) + h[words.first[short[has]] + i])
        out, row = np.concatenate([out, whole]), np.concatenate([row, short])
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    if len(out):
        new = np.r_[True, (out[1:] != out[:-1]) | (row[1:] != row[:-1])]
        out, row = out[new], row[new]
    return row, out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature): set_a and set_b are 128 bits that stand for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, flat, off in chunks(b.column(1)):
                rows = len(off) - 1
                row, h = shingle_sets(flat, off, k)
                n = np.bincount(row, minlength=rows)
                a, c = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                sig = np.zeros((rows, POSITIONS), np.uint16)
                if len(h):
                    at = run_starts(row)
                    own = row[at]
                    a[own] = np.add.reduceat(mix(h), at)
                    c[own] = np.add.reduceat(mix(h ^ U64(0xA5A5A5A5A5A5A5A5)), at)
                    for i, m in enumerate(MULTIPLIERS):
                        low = np.minimum.reduceat(h * m, at)
                        sig[own, i] = (mix(low) >> U64(48)).astype(np.uint16)
                raw = sig.tobytes()
                step = POSITIONS * 2
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, rows), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array([raw[i * step : (i + 1) * step] for i in range(rows)], pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def chunk_keys(vertices: DataFrame, distance: int) -> DataFrame:
    """(key, id) for every chunk and every position left out of it."""
    bounds = chunk_bounds(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS).astype(np.uint64)
                ids = part.column(0).to_numpy()
                keys = []
                for c, (lo, hi) in enumerate(bounds):
                    for out in range(lo, hi):
                        key = np.full(len(sig), c * POSITIONS + out, np.uint64)
                        for i in range(lo, hi):
                            if i != out:
                                key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, i] + U64(1))
                        keys.append(key)
                keys = np.stack(keys, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "id"])

    return vertices.select("id", "signature").mapInArrow(tidy(run), "key long, id long")


def pivot_groups(keys: DataFrame) -> DataFrame:
    """(pivot, id): the vertices that share a key with others, under the partner that shares the most."""
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stage(keys.join(shared, "key"), "members")
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "id").select("key", "id", F.struct(F.col("degree"), (-F.col("id")).alias("minus")).alias("rank"))
    pivots = ranked.groupBy("key").agg((-F.max("rank")["minus"]).alias("pivot"))
    return members.join(pivots, "key").filter("id <> pivot").select("pivot", "id").distinct()


def block_rows(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(unit, id, side): each group with its pivot, cut into blocks of bounded size; a unit is a pair of blocks (or one)."""
    sized = groups.join(sizes, "id")
    # Only pivots of several blocks are in this table, so it is a small share of the vertices at most; a group isn't gathered to learn its size.
    large = sized.groupBy("pivot").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks")).filter("blocks > 1")
    placed = sized.join(stage(large, "large"), "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("pivot", F.least("block", "other"), F.greatest("block", "other"))
    rows = other.select(unit.alias("unit"), "id", (F.col("block") > F.col("other")).cast("int").alias("side"), "pivot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    with_pivot = rows.select("unit", F.col("pivot").alias("id"), F.lit(-1).alias("side")).distinct()
    return rows.select("unit", "id", "side").union(with_pivot)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links_of_unit(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one unit, found on full sets. The pivot comes first."""
    order = np.argsort(sides, kind="stable")
    ids, sides, sets = ids[order], sides[order], [sets[i] for i in order]
    n = len(ids)
    size = np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    by_value = np.argsort(code, kind="stable")
    posting, first = owner[by_value], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(values)))])
    forest, found = Forest(n), []

    def partners(i: int) -> np.ndarray:
        own = code[start[i] : start[i + 1]]
        counts = first[own + 1] - first[own]
        where = np.repeat(first[own] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        same = np.bincount(posting[where], minlength=n)
        return np.flatnonzero(100 * same >= percent * (size + size[i] - same))

    def link(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if j != i and size[i] and size[j] and forest.join(i, j):
                found.append((int(ids[i]), int(ids[j])))

    link(0, partners(0))
    for i in range(1, n):
        if forest.find(i) != forest.find(0):
            link(i, partners(i))
    return found


def verified_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of the units' spanning forests. Units are bounded, so a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, sides, own = None, [], [], []

        def done() -> list[tuple[int, int]]:
            return links_of_unit(np.array(ids), np.array(sides), own, percent) if len(ids) > 1 else []

        for b in batches:
            out: list[tuple[int, int]] = []
            for u, i, s, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if u != unit:
                    out += done()
                    unit, ids, sides, own = u, [], [], []
                ids.append(i)
                sides.append(s)
                own.append(np.frombuffer(h.as_buffer(), np.uint64).copy())
            yield edges(out)
        yield edges(done())

    def edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    joined = rows.join(sets, "id").select("unit", "id", "side", "shingles")
    return joined.repartition("unit").sortWithinPartitions("unit").mapInArrow(tidy(run), "a long, b long")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, shingles): each text's distinct shingle hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, flat, off in chunks(b.column(1)):
                rows = len(off) - 1
                row, h = shingle_sets(flat, off, k)
                cut = np.searchsorted(row, np.arange(rows + 1)) * 8
                raw = h.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), pa.array([raw[cut[i] : cut[i + 1]] for i in range(rows)], pa.binary())], ["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "id long, shingles binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for rows (doc_id, text): links are Jaccard >= percent/100."""
    signed = stage(signatures(docs, k), "signatures")
    one = ["set_a", "set_b", "n_shingles"]
    vertices = stage(signed.filter("n_shingles > 0").groupBy(*one).agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")), "vertices")
    groups = stage(pivot_groups(chunk_keys(vertices, distance_bound(percent / 100))), "groups")
    needed = stage(groups.select("id").union(groups.select("pivot")).distinct(), "needed")
    # An inner join: Spark would push a semi join below the filter. The needed ids are distinct.
    texts = might_be_in(docs.select("doc_id", "text"), needed).join(needed, F.col("doc_id") == F.col("id")).select("doc_id", "text").dropDuplicates(["doc_id"])
    rows = block_rows(groups, vertices.select("id", "n_shingles"))
    links = verified_links(rows, full_sets(texts, k), percent)
    classes = components(links)
    named = vertices.join(classes, "id", "left").select(*one, F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", *one).join(named, one, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def op7_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


# Spark's result on sf0.01 takes DuckDB a second; recursion reaches the smallest id.
OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, other) AS (SELECT a, b FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a),
low AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, coalesce(l.component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN low l ON s.doc_id = l.id
"""

"""Target-distribution importance resampling with partition-local word tries.

Features are the runs of 1 to `longest` consecutive words of a text, hashed to
buckets by CRC-32. A task puts the runs of its rows into a trie of words: each
node holds how often its run occurred and the CRC state of its bytes, so a
longer run's state continues its parent's and no run is ever written out as a
string. A task's nodes are added up into bucket totals, the only thing that is
shuffled (a partition gives at most one row per bucket). The bucket gains, the
logarithms of the target's smoothed share over the corpus's, are then attached to the nodes of
a second trie, and a document's weight is the sum over the trie paths that
its words walk. Gumbel noise from a hash of the id turns weights into scores whose
largest are a sample without replacement.

A trie is emptied when it has MOST_NODES nodes, so a task's memory is bounded
however many distinct words it meets; totals and weights do not depend on it.

Cases: a null text has no words, no features and weight 0. A document is scored
whatever its length and drawn only from those with least_words words. Equal scores go to
the smaller doc_id, a null doc_id counts as none (hashed as the empty string, last among equals); repeated rows are rows of their own. Extra columns
don't matter. An empty benchmark or an empty corpus leaves all shares equal to the smoothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import places, stage, table
from .textbytes import tidy

BUCKETS = 10_000
LONGEST = 1
SEED = "2024"
PERCENT = 10
LEAST_WORDS = 20
MOST_NODES = 400_000

# lower-cases A-Z, keeps a-z, digits and all bytes of characters beyond ASCII, blanks the rest
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


class Node(dict):
    """A trie node: its children by word, the CRC state of its run, and a value (a count, or the bucket's gain)."""

    __slots__ = ("state", "value")

    def __init__(self, state: int, value: int = 0):
        super().__init__()
        self.state, self.value = state, value


class Trie:
    def __init__(self, longest: int, gains: list[int] | None = None):
        self.longest, self.gains = longest, gains
        self.clear()

    def clear(self) -> None:
        self.root, self.size = Node(0), 0

    def child(self, node: Node, word: bytes) -> Node:
        """The node's child for a word, made where it isn't there; one space stands between words."""
        found = node.get(word)
        if found is None:
            state = zlib.crc32(word if node is self.root else b" " + word, node.state)
            found = node[word] = Node(state, self.gains[state % len(self.gains)] if self.gains else 0)
            self.size += 1
        return found

    def paths(self, words: list[bytes]) -> Iterator[Node]:
        """The nodes of all runs of 1 to `longest` words."""
        child, root = self.child, self.root
        if self.longest == 1:
            for word in words:
                yield child(root, word)
            return
        live: list[Node] = []  # nodes of the runs that end at the previous word, longest first
        for word in words:
            live = [child(node, word) for node in (*live[-(self.longest - 1) :], root)]
            yield from live

    def totals(self, into: np.ndarray) -> None:
        """Adds the nodes' counts to bucket totals."""
        open_ = [self.root]
        while open_:
            for node in open_.pop().values():
                into[node.state % len(into)] += node.value
                if node:
                    open_.append(node)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket that has any. texts: a column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, sums = Trie(longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                for node in trie.paths(words_of(data.as_py())):
                    node.value += 1
                if trie.size > MOST_NODES:
                    trie.totals(sums)
                    trie.clear()
        trie.totals(sums)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(sums[hit])], names=["bucket", "n"])

    data = texts.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    return data.mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, gain) for every bucket: 1000 times the logarithm of the target's share over the corpus's, each with one added per bucket."""
    mine = bucket_counts(corpus, buckets, longest).withColumnRenamed("n", "s")
    theirs = bucket_counts(target, buckets, longest).withColumnRenamed("n", "t")
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = stage(every.join(mine, "bucket", "left").join(theirs, "bucket", "left").fillna(0), "bucket-counts")
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    t, s = F.col("t").cast("double"), F.col("s").cast("double")
    share = (t + 1.0) * (F.col("all_s") + float(buckets)) / ((s + 1.0) * (F.col("all_t") + float(buckets)))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain"))  # sums is one row


def weigh(docs: DataFrame, gains: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document. gains has one row per bucket and goes to every task."""
    table_ = [0] * buckets
    for row in gains.collect():  # `buckets` rows, a parameter
        table_[row["bucket"]] = row["gain"]
    shared = docs.sparkSession.sparkContext.broadcast(table_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, shared.value)
        for batch in batches:
            counts = []
            for data in batch.column("data"):
                words, n, weight = words_of(data.as_py()), 0, 0
                for node in trie.paths(words):
                    weight += node.value
                    n += 1
                counts.append((len(words), n, weight))
                if trie.size > MOST_NODES:
                    trie.clear()
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    return data.mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """1000 times standard Gumbel noise, by a hash of the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """Every document's features, weight and score, and the rank of those drawn: the percent of eligible ones with the highest scores."""
    weighed = weigh(docs, bucket_gains(docs.select("text"), target.select("text"), buckets, longest), buckets, longest)
    scored = stage(weighed.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "able": F.col("n_words") >= least_words}), "scored")
    placed = places(scored, [], [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")], "ranked")
    able = scored.filter("able").count()
    drawn = F.col("able") & (F.col("place") <= percent * able // 100)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))


def op12_word_trie_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws a tenth of the documents by single-word features towards the benchmark; all documents come back, rank null where not drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


CRC_TABLE_SQL = "SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))"


def crc_sql(text: str, steps: str) -> str:
    """CRC-32 of the UTF-8 bytes of `text`, with the 256 steps of CRC_TABLE_SQL."""
    bytes_ = f"list_transform(range(length(hex(encode({text}))) // 2), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, {steps}[xor(c % 256, b) + 1])))"


OP12_SQL = f"""
WITH crc AS ({CRC_TABLE_SQL}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
goals AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
mine AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM docs) GROUP BY w),
theirs AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM goals) GROUP BY w),
vocabulary AS (SELECT w, {crc_sql("w", "steps")} % {BUCKETS} AS b FROM (SELECT w FROM mine UNION SELECT w FROM theirs), crc),
s AS (SELECT b, sum(n) AS n FROM mine JOIN vocabulary USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS n FROM theirs JOIN vocabulary USING (w) GROUP BY b),
sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t_all),
gains AS (
  SELECT i AS b, floor(1000::DOUBLE * ln((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + {BUCKETS}) / ((coalesce(s.n, 0)::DOUBLE + 1) * (t_all + {BUCKETS}))))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i, sums),
weights AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM (SELECT r, unnest(w) AS w FROM docs) JOIN vocabulary USING (w) JOIN gains USING (b) GROUP BY r),
scored AS (
  SELECT d.r, d.doc_id, len(d.w) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs d LEFT JOIN weights USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {LEAST_WORDS} AND place <= (SELECT {PERCENT} * count(*) // 100 FROM scored WHERE n_features >= {LEAST_WORDS}) THEN place END AS rank
FROM ranked
"""

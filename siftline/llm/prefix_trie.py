"""Prefix trie of conversations, built level by level, with sums rolled up level by level.

A node is a distinct sequence of first turns; the smallest conv_id that starts with it
and its depth name it. Turns are reduced to a digest of role and text, so levels move
a few bytes per conversation. At each depth the live conversations, those
that still share their node with another, are grouped by (parent node, next
turn); a group's smallest conv_id is the new node. A conversation alone in its node has
one chain below, which needs no more levels, so there are as many levels as the longest shared beginning has
turns. Then, from the deepest level up, each level joins what its children add
up to: children, leaves and savings.

Groups are added up by partial aggregates and joined back on (parent, turn), a join
that adaptive execution splits where one beginning is in a large part of all conversations. The
conversations that end in a node are sorted by ranges and packed into chunks before one
task hashes a node's chunks in order, with one digest state in memory. Levels are written tables.

Cases: turns go by turn (null first), equal turn numbers by the digest of role and text; repeated rows are
turns of their own. Null role or text is empty. Rows without conv_id are left out. A conversation
without turns is a member of the root only. Extra columns don't matter. Without any conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import places, stage, table
from .textbytes import tidy
from .word_tries import CRC_TABLE_SQL, crc_sql

STRIDE, LEADS = 20, 4
CHUNK_IDS = 400
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words): every conversation's turns numbered from 1, as digests with their number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return places(stage(rows, "turns"), ["conv_id"], [F.asc_nulls_first("turn"), F.asc("key")], "turn-order").select("conv_id", F.col("place").alias("pos"), "key", "words")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, node, conv_id) rows to chunks of ids joined by commas."""
    node, ids, out = None, [], []

    def close():
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)] + [pa.array([o[3] for o in out], pa.string())], names=["depth", "node", "first", "ids"])
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != node or len(ids) >= CHUNK_IDS:
                close()
                node = row[:2]
            ids.append(row[2])
        if len(out) >= 2_000:
            yield flush()
    close()
    yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first id to one digest per node; the state goes on from batch to batch."""
    node, state = None, None
    for batch in batches:
        done = []
        for depth, name, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, name) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, name), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digest_rows(done)
    if node:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["e_depth", "e_node", "ends"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(e_depth, e_node, ends): SHA-256 of each node's ids in (depth, node, conv_id), ascending and comma-joined."""
    order = ["depth", "node", "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_packed), "depth long, node long, first long, ids string")
    chunks = stage(packed, "end-chunks")
    return chunks.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(tidy(_hashed), "e_depth long, e_node long, ends string")


def levels(turns: DataFrame, convs: DataFrame, root: int, n_convs: int) -> list[DataFrame]:
    """Per depth from 1: (conv_id, n_turns, parent, node, n_convs, words) of every conversation that was live one level above and goes on."""
    found, depth = [], 0
    live = convs.select("conv_id", "n_turns", F.lit(root).cast("long").alias("parent"))
    while True:
        depth += 1
        step = live.filter(F.col("n_turns") >= depth).join(turns.filter(F.col("pos") == depth).select("conv_id", "key", "words"), "conv_id")
        groups = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"))
        level = stage(step.join(groups, ["parent", "key"]).select("conv_id", "n_turns", "parent", "node", "n_convs", "words"), f"level-{depth}")
        if level.isEmpty():
            return found
        found.append(level)
        live = level.filter("n_convs > 1").select("conv_id", "n_turns", F.col("node").alias("parent"))


def rolled_up(level: DataFrame, depth: int, below: DataFrame | None) -> DataFrame:
    """The nodes of a level with what their children (parent, children, leaves, saved) add up to."""
    nodes = level.filter("conv_id = node").select("node", "parent", "n_turns", F.lit(depth).cast("long").alias("depth"), "n_convs", "words")
    sums = ["children", "leaves", "saved"]
    if below is None:
        nodes = nodes.withColumns({s: F.lit(0).cast("long") for s in sums})
    else:
        nodes = nodes.join(below.withColumnRenamed("parent", "of"), F.col("node") == F.col("of"), "left").drop("of").fillna(0, sums)
    alone = F.col("n_convs") == 1
    return nodes.select(
        "node", "parent", "depth", "n_turns", "n_convs",
        F.when(alone, (F.col("n_turns") > depth).cast("long")).otherwise(F.col("children")).alias("n_children"),
        F.when(alone | (F.col("children") == 0), F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )


def conversation_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie. turns: (conv_id, pos, key, words), pos from 1 without gaps; convs: (conv_id, n_turns), turnless ones too."""
    spark = turns.sparkSession
    top = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    if not top["n"]:
        return spark.createDataFrame([], NODE)
    turns = stage(turns.select("conv_id", "pos", "key", "words").repartitionByRange("pos", "conv_id"), "turns-by-place")  # a level reads only its files' row groups
    found = levels(turns, convs, top["root"], top["n"])
    ends = convs.filter("n_turns = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(top["root"]).cast("long").alias("node"), "conv_id")
    nodes, chains, below = [], [], None
    for depth in range(len(found), 0, -1):
        level = found[depth - 1]
        rolled = stage(rolled_up(level, depth, below), f"nodes-{depth}")
        nodes.append(rolled)
        below = rolled.groupBy("parent").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        ends = ends.union(level.filter((F.col("n_convs") > 1) & (F.col("n_turns") == depth)).select(F.lit(depth).cast("long"), "node", "conv_id"))
        chains.append(rolled.filter("n_convs = 1").select("node", F.explode(F.sequence(F.lit(depth).cast("long"), F.col("n_turns"))).alias("depth"), "n_turns", "parent", F.lit(depth).alias("top")))

    one, nothing = F.lit(1).cast("long"), F.sha2(F.lit(""), 256)
    root_sums = [F.lit(top["root"]).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(top["n"]).cast("long").alias("n_convs")]
    if below is None:  # nobody has a turn
        root = spark.range(1).select(*root_sums, F.lit(0).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    else:
        root = below.select(*root_sums, F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    columns = ["node", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = root.select(columns)
    for n in nodes:
        shared = shared.union(n.filter("n_convs > 1").select(columns))
    shared = shared.join(end_digests(ends), (F.col("depth") == F.col("e_depth")) & (F.col("node") == F.col("e_node")), "left")
    out = shared.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", nothing).alias("ends_sha256"))
    for chain in chains:
        last = F.col("depth") == F.col("n_turns")
        parent = F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("node"))
        out = out.union(chain.select("node", "depth", parent, one, (~last).cast("long"), one, F.lit(0).cast("long"), F.when(last, F.sha2(F.col("node").cast("string"), 256)).otherwise(nothing)))
    return out


def rebuilt(turns: DataFrame, stride: int = STRIDE, leads: int = LEADS) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations where c's first h turns are those of c - c % stride; h is the CRC-32 of the decimal c, modulo leads."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    lead = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(leads))
    base = F.col("conv_id") - F.col("conv_id") % stride
    first = convs.filter(F.col("conv_id") % stride == 0).select(F.col("conv_id").alias("base_id"), F.col("own").alias("base_n"))
    with_base = convs.withColumns({"base": base, "h": lead}).join(first, F.col("base") == F.col("base_id"), "left")
    led = F.least(F.col("h"), F.coalesce(F.col("base_n"), F.lit(0)))
    convs = stage(with_base.select("conv_id", "base", "h", led.alias("led"), (led + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns")), "conversations")
    own = turns.join(convs.select("conv_id", "h", "led"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("led")).alias("pos"), "key", "words")
    heads = turns.filter((F.col("conv_id") % stride == 0) & (F.col("pos") < leads)).withColumnRenamed("conv_id", "base")
    taken = convs.filter("led > 0").select("conv_id", "base", "led").join(heads, "base").filter("pos <= led").select("conv_id", "pos", "key", "words")
    return own.union(taken), convs.select("conv_id", "n_turns")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that they share beginnings."""
    turns = ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conversation_trie(*rebuilt(stage(turns, "numbered-turns")))


OP13_SQL = f"""
WITH crc AS ({CRC_TABLE_SQL}),
turns AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'key': key, 'words': words}} ORDER BY turn NULLS FIRST, key) AS ts FROM turns GROUP BY conv_id),
leads AS (SELECT conv_id, conv_id - conv_id % {STRIDE} AS base, {crc_sql("conv_id::VARCHAR", "steps")} % {LEADS} AS h, ts FROM own, crc),
built AS (SELECT l.conv_id, list_concat(coalesce(b.ts, [])[1:l.h], l.ts[l.h + 1:]) AS ts FROM leads l LEFT JOIN own b ON b.conv_id = l.base),
steps AS (SELECT conv_id, ts, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS depth FROM built),
prefixes AS (SELECT conv_id, n, depth, list_transform(ts[1:depth], lambda x: x.key) AS prefix, coalesce(ts[depth].words, 0) AS words FROM steps),
placed AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM prefixes),
nodes AS (
  SELECT depth, node, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM placed GROUP BY depth, node),
linked AS (
  SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN placed p ON p.conv_id = n.node AND p.depth = n.depth - 1),
children AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.parent = l.node AND c.depth = l.depth),
sums AS (
  SELECT p.depth, p.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved
  FROM full_nodes f JOIN placed p ON p.conv_id = f.node AND p.depth <= f.depth GROUP BY p.depth, p.node)
SELECT f.node AS conv_id, f.depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s USING (depth, node)
"""

"""Removal of repeated passages by merging shard Burrows-Wheeler transforms.

Every LENGTH-byte window of a text that also starts in a document with a smaller
doc_id is removed, whatever its offset; overlapping windows add up.

1. Equal texts are one text: later copies of a text of LENGTH bytes or more go whole,
   shorter ones stay; the first one stands for all of them below.
2. Windows are grouped by their minimizer, the smallest hash of their ANCHOR-byte
   strings. Equal windows have equal minimizers, so an anchor that no second document
   has rules its windows out. Anchors travel packed, in ranges of the hash, after each
   task has settled those it sees twice itself.
3. The stretches of text around the other anchors (runs of windows with one minimizer)
   are made distinct within a batch of documents, with their first document there, and
   go packed to units by anchor. The most frequent anchors (at most MOST_HOT of them,
   from HOT documents on) are dealt by the hash of each window instead, so no anchor
   meets in one unit with more than a batch's worth per batch.
4. The stretches of a unit form two shards, by a hash. A task makes a shard's stretches
   distinct and builds their Burrows-Wheeler transform, in pieces of bounded size by anchor;
   what leaves it is the transform and the strings' first documents, in its order.
5. Another task merges the two shards' transforms by interleave refinement: a round sorts
   the interleave of all suffixes by STEP more symbols, by one stable counting pass over
   the previous one, without comparing suffixes, and leaves out suffixes that have ended.
   The boundaries that appear in a round
   give the common prefixes (down to a multiple of STEP); the intervals whose common prefix
   is LENGTH are the repeated ones, and each one's smallest first document decides its
   windows. Walking the transforms backwards tells which row is which place of which string.
6. The decisions go back to the batches they came from, which turn them into one bit
   per window and document, and those to the texts.

The numbers of ranges and units follow the bytes, so that what a task holds doesn't grow.

Texts cross the network compressed, and only those that may hold a repeat do.

Cases: null texts are empty; texts shorter than LENGTH bytes are never cut; windows
never cross documents; a window that repeats inside one document only is kept;
repeated rows (equal doc_id and text) are one document; NUL bytes are bytes like
others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop, might_be_in, stage, table
from .textbytes import BASE, BASE_INVERSE, BYTE_CODE, U64, chunks, mix, powers, rolling, run_starts, sliding_min, tidy

LENGTH = 50
ANCHOR = 20
MOST_WINDOWS = 32  # of one stretch
FLUSH = 500_000
PIECE = 10_000  # settled anchors that travel together
BATCH = 100_000
RANGE_BYTES = 32 << 20  # of anchors
UNIT_BYTES = 24 << 20  # of stretches, before they are made distinct
PIECE_BYTES = 50_000  # of the stretches of a unit that are merged together
STRETCH_BYTES = 72  # about
STEP = 10
HOT = 2_000
MOST_HOT = 100_000


def stretches(flat: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor) of the runs of windows with one minimizer, in order of position."""
    low = sliding_min(rolling(flat, ANCHOR), length - ANCHOR + 1)
    starts = np.arange(len(low))
    row = np.searchsorted(off, starts, "right") - 1
    inside = starts + length <= off[row + 1] if len(low) else np.zeros(0, bool)
    starts, row, low = starts[inside], row[inside], low[inside]
    if not len(starts):
        return row, starts, starts, low
    new = np.ones(len(starts), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    run = np.cumsum(new) - 1
    place = np.arange(len(starts)) - np.flatnonzero(new)[run]
    new |= place % MOST_WINDOWS == 0
    at = np.flatnonzero(new)
    return row[at], starts[at], np.diff(np.r_[at, len(starts)]), low[at]


def pack(values: np.ndarray) -> bytes:
    """64-bit values as byte planes, which shuffle compression shrinks where the values are sorted or small."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def frame(*arrays: np.ndarray) -> bytes:
    """Compressed arrays of 64-bit numbers or bytes; see unframe."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unframe(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    head = np.frombuffer(raw, np.int64, 1 + 2 * int(np.frombuffer(raw, np.int64, 1)[0]))
    at, out = head.nbytes, []
    for size, n in head[1:].reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, {1: np.uint8, 4: np.int32, 8: np.int64}[size], n, at))
        at += size * n
    return out


def packed_anchors(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, settled, anchors, docs, counts): anchors in ranges of their hash; those that a task sees in two documents are settled.

    In the ranges an anchor stands once per batch, with one document and the number of the batch's documents.
    """
    shift = U64(40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            anchor, doc = np.concatenate([a for a, _ in held]), np.concatenate([d for _, d in held])
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            keep = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
            anchor, doc = anchor[keep], doc[keep]
            first = run_starts(anchor)
            n = np.diff(np.r_[first, len(anchor)])
            again = np.repeat(n > 1, n)
            known, own = anchor[again], doc[again]
            begin = int(mix(known[:1])[0] % U64(ranges)) if len(known) else 0
            rows = [((begin + i // PIECE) % ranges, True, pack(known[i : i + PIECE]), pack(own[i : i + PIECE]), b"") for i in range(0, len(known), PIECE)]
            anchor, doc = anchor[first], doc[first]
            n = n.astype(np.uint64)
            which = ((anchor >> shift) * U64(ranges) >> U64(24)).astype(np.int64)  # ascending with the anchor
            cut = np.searchsorted(which, np.arange(ranges + 1))
            rows += [(r, False, *(pack(v[cut[r] : cut[r + 1]]) for v in (anchor, doc, n))) for r in range(ranges) if cut[r] < cut[r + 1]]
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], ["range", "settled", "anchors", "docs", "counts"])

        for b in batches:
            ids = b.column(0).to_numpy().astype(np.int64)
            for at, flat, off in chunks(b.column(1)):
                row, _, _, anchor = stretches(flat, off)
                if len(row):
                    held.append((anchor, ids[at + row].view(np.uint64)))
                    size += len(row)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "range int, settled boolean, anchors binary, docs binary, counts binary")


def shared_anchors(docs: DataFrame, text_bytes: int) -> DataFrame:
    """(doc_id, anchor, documents) of the anchors that two documents or more have. Rows of frequent anchors with null doc_id have the number of documents."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-2 * text_bytes // RANGE_BYTES))  # an anchor with its document and count, 24 bytes, every 16 bytes of text
    ranges = 2 * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out(anchor: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc.view(np.int64)), pa.array(anchor.view(np.int64)), pa.nulls(len(doc), pa.int64())], ["doc_id", "anchor", "documents"])

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                anchor, doc, count = (np.concatenate([x[k] for x in held]) for k in range(3))
                order = np.argsort(anchor)
                anchor, doc, count = anchor[order], doc[order], count[order]
                first = run_starts(anchor)
                n = np.diff(np.r_[first, len(anchor)])
                two = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                again = np.repeat(two, n)
                yield out(anchor[again], doc[again])
                total = np.add.reduceat(count, first).astype(np.int64)
                hot = total >= HOT
                yield pa.RecordBatch.from_arrays([pa.nulls(int(hot.sum()), pa.int64()), pa.array(anchor[first][hot].view(np.int64)), pa.array(total[hot])], ["doc_id", "anchor", "documents"])

        for b in batches:
            for r, settled, *parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4), strict=True):
                parts = [unpack(x.as_py()) for x in parts]
                if settled:
                    yield out(*parts[:2])
                    continue
                if r != now:
                    yield from done()
                    now, held = r, []
                held.append(parts)
        yield from done()

    packed = packed_anchors(docs, ranges)
    return packed.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(tidy(run), "doc_id long, anchor long, documents long")


def compressed(docs: DataFrame) -> DataFrame:
    """docs with the text's UTF-8 bytes compressed in place of the text (column `packed`, last)."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = pa.array([None if t is None else press.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), packed], [*names, "packed"])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("packed", T.BinaryType())])
    return docs.mapInArrow(tidy(run), schema)


def opened(packed: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else press.decompress(x).decode() for x in packed.to_pylist()], pa.string())


def span_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, their lengths included."""
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE_CODE[flat] * powers(BASE, len(flat)), out=total[1:])
    return mix((total[end] - total[start]) * powers(BASE_INVERSE, len(flat) + 1)[start] + (end - start).astype(np.uint64) * U64(0xD1B54A32D192ED03))


def packed_stretches(texts: DataFrame, shared: DataFrame, hot: np.ndarray, units: int, pieces: int, length: int = LENGTH) -> DataFrame:
    """Batches of stretches whose anchor another document has too: (batch, unit, data), all data compressed.

    Rows with a unit have that unit's distinct stretches of the batch, those of its first shard
    under twice the unit, those of its second under one more; the row with unit -1
    says which document has which stretch where. texts has doc_id and packed.
    A task that runs again makes the same batches under the same names.
    """
    wanted = shared.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    known_hot = texts.sparkSession.sparkContext.broadcast(np.sort(hot))  # at most MOST_HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # per chunk: contents' bytes and lengths, keys, documents, positions, windows, content hashes
        size, batch = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal batch
            raw = np.concatenate([x[0] for x in held])
            lengths, key, doc, at, windows, content = (np.concatenate([x[k] for x in held]) for k in range(1, 7))
            end = np.cumsum(lengths)
            start = end - lengths
            _, first, which = np.unique(content, return_index=True, return_inverse=True)
            low = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(low, which, doc)
            unit = (mix(key[first]) % U64(units)).astype(np.int64) * 2 + (content[first] >> U64(63)).astype(np.int64)
            order = np.lexsort((key[first], unit))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            which, first, low, unit = place[which], first[order], low[order], unit[order]
            cut = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
            batch += 1
            rows = [(batch, -1, frame(which, doc, at, windows))]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own = first[lo:hi]
                n = lengths[own]
                body = raw[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                rows.append((batch, int(unit[lo]), frame(np.array([lo]), n.astype(np.uint8 if length < 200 else np.int32), (mix(key[own] + U64(0x7F4A7C15)) % U64(pieces)).astype(np.int32), low[lo:hi], content[own].view(np.int64), body)))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows], pa.binary())], ["batch", "unit", "data"])

        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(2)
            border, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)
            for first, flat, off in chunks(opened(b.column(1))):
                rows = len(off) - 1
                row, start, windows, key = stretches(flat, off, length)
                own = values[border[first] : border[first + rows]]
                owner = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(border[first : first + rows + 1]))
                hit = np.isin(mix(key + row.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), mix(own + owner * U64(0x9E3779B97F4A7C15)))
                row, start, windows, key = row[hit], start[hit], windows[hit], key[hit]
                if len(known_hot.value) and len(key):  # a frequent anchor's windows one by one, under their own hash
                    many = np.isin(key, known_hot.value)
                    if many.any():
                        n = windows[many]
                        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        s = np.repeat(start[many], n) + step
                        own_hash = span_hashes(flat, s, s + length)
                        row, start = np.r_[row[~many], np.repeat(row[many], n)], np.r_[start[~many], s]
                        windows, key = np.r_[windows[~many], np.ones(len(s), windows.dtype)], np.r_[key[~many], own_hash]
                if not len(row):
                    continue
                lengths = windows + length - 1
                take = np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                held.append((flat[take], lengths, key, ids[first + row], start - off[row], windows.astype(np.int64), span_hashes(flat, start, start + lengths)))
                size += len(row)
                if size >= BATCH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    ids = stage(shared.filter("doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "ids")
    joined = might_be_in(texts.select("doc_id", "packed"), ids).join(wanted, "doc_id").select("doc_id", "packed", "anchors")
    return joined.sortWithinPartitions("doc_id").mapInArrow(tidy(run), "batch long, unit long, data binary")


def cyclic_order(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, before, string) of closed strings that stand one after the other: rotations in full order, each place's predecessor, its string.

    Ranks by seven symbols, then by 14, 28 and so on, until all differ; the strings must be distinct.
    """
    n = len(flat)
    start = np.cumsum(size) - size
    string = np.repeat(np.arange(len(size)), size)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[start + size - 1], before[start] = start, start + size - 1
    rank, jump = np.zeros(n, np.int64), np.arange(n)
    for _ in range(7):
        rank = rank << 9 | flat[jump]
        jump = after[jump]
    reach, rows = 7, np.argsort(rank)
    while True:
        key = rank[rows]
        step = np.zeros(n, np.int64)
        step[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[rows] = np.cumsum(step)
        if not n or rank[rows[-1]] == n - 1 or reach > 2 * int(size.max()):
            return rows, before, string
        rank = rank * n + rank[jump]
        rows = np.argsort(rank)
        jump, reach = jump[jump], 2 * reach


class ShardTransform:
    """The Burrows-Wheeler transform of a set of strings, each closed by a terminator (symbol 0; byte b is b + 1).

    Rows are the rotations of the closed strings in full order; symbols has the symbol before
    each. The strings are known by their place in sorted order, which the rows that begin with
    a terminator, the first ones, are in.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.back = np.empty(len(symbols), np.int64)  # the row of the rotation that begins one symbol earlier
        self.back[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
        self.strings = int((symbols == 0).sum())

    @classmethod
    def build(cls, strings: list[bytes]) -> tuple[ShardTransform, np.ndarray]:
        """The transform and the strings' indices in its order."""
        symbols, order = shard_symbols(np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings], np.int64))
        return cls(symbols), order

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, offset) of every row and the strings' lengths, by walking backwards from all terminators at once."""
        string, end = np.empty(len(self.symbols), np.int64), np.empty(len(self.symbols), np.int64)
        length = np.zeros(self.strings, np.int64)
        row = own = np.arange(self.strings)
        far = 0
        while len(row):
            string[row], end[row] = own, far
            go = self.symbols[row] != 0
            length[own[~go]] = far
            row, own = self.back[row[go]], own[go]
            far += 1
        return string, length[string] - end, length

    def earlier(self, step: int) -> np.ndarray:
        """The row of the rotation that begins `step` symbols earlier."""
        row = self.back
        for _ in range(step - 1):
            row = self.back[row]
        return row

    def grams(self, step: int) -> np.ndarray:
        """The `step` symbols before each rotation as one number in their order."""
        row, out = np.arange(len(self.symbols)), np.zeros(len(self.symbols), np.int64)
        for k in range(step):
            out |= self.symbols[row].astype(np.int64) << (9 * k)
            row = self.back[row]
        return out


def shard_symbols(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transform, strings' indices in its order) of distinct strings that stand one after the other."""
    closed = np.zeros(len(flat) + len(size), np.uint8 if flat.max(initial=0) < 255 else np.uint16)
    closed[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat.astype(closed.dtype) + 1
    rows, before, string = cyclic_order(closed, size + 1)
    return closed[before[rows]], string[rows[: len(size)]]


def gram_ranks(a: ShardTransform, b: ShardTransform, step: int) -> np.ndarray:
    """The place of the `step` symbols before each row of a, then of b, among all such; seven symbols fit a number, more are ranked by their halves."""
    if step <= 7:
        value = np.concatenate([a.grams(step), b.grams(step)])
    else:
        half = gram_ranks(a, b, step // 2)
        late = gram_ranks(a, b, step - step // 2).astype(np.int64) if step % 2 else half.astype(np.int64)
        earlier = np.concatenate([a.earlier(step - step // 2), b.earlier(step - step // 2) + len(a.symbols)])
        value = half[earlier].astype(np.int64) * (int(late.max(initial=0)) + 1) + late
    values, rank = np.unique(value, return_inverse=True)
    return rank.astype(np.uint16 if len(values) <= 1 << 16 else np.uint32)


def merge_transforms(a: ShardTransform, b: ShardTransform, depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lcp) after interleave refinement of two transforms to `depth` symbols, for the suffixes of that length or more.

    rows are rows of a, and rows of b counted on from them, interleaved in the order of their
    first `depth` symbols (those of one transform keep their order); lcp[i] is how many symbols
    row i shares with row i - 1, at most depth and down to a multiple of step. A round takes
    the `step` symbols before each row at once; depth must be a multiple of step.
    """
    places = [t.places for t in (a, b)]
    kind = np.uint8 if max((int(size.max(initial=0)) for _, _, size in places), default=0) < 256 else np.int32
    offset = np.concatenate([at for _, at, _ in places]).astype(kind)
    left = np.concatenate([size[string] - at for string, at, size in places]).astype(kind)
    rank = gram_ranks(a, b, step)
    before = np.concatenate([a.earlier(step), b.earlier(step) + len(a.symbols)]).astype(np.int32)
    rows = np.arange(len(before), dtype=np.int32)
    block, lcp = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
    for h in range(0, depth, step):
        # The boundaries so far, of the suffixes that go on.
        stay = np.flatnonzero(left[rows] >= h + step)
        if not len(stay):
            return rows[:0], lcp[:0]
        lcp = np.minimum.reduceat(lcp[: stay[-1] + 1], np.r_[0, stay[:-1] + 1])
        # Every row leads to the one `step` symbols before it in its string, where there is one.
        leads = np.flatnonzero(offset[rows] >= step)
        rows, block = rows[leads], block[leads]
        symbols = rank[rows]
        order = np.argsort(symbols, kind="stable")
        symbols, block, rows = symbols[order], block[order], before[rows[order]]
        border = np.ones(len(order), bool)
        np.not_equal(symbols[1:], symbols[:-1], out=border[1:])
        border[1:] |= block[1:] != block[:-1]
        lcp = np.where(border, np.minimum(lcp, np.int32(h)), np.int32(h + step))
        block = np.cumsum(border, dtype=np.int32)
    return rows, lcp


def first_documents(a: ShardTransform, b: ShardTransform, first: tuple[np.ndarray, np.ndarray], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each shard (windows of each string, for every window the smallest first document of the strings that hold it)."""
    step = next(k for k in (STEP, 5, 4, 3, 2, 1) if length % k == 0)
    rows, lcp = merge_transforms(a, b, length, step)
    low = np.concatenate([own[t.places[0]] for t, own in ((a, first[0]), (b, first[1]))])[rows]
    if len(low):
        interval = np.flatnonzero(lcp < length)  # where a repeated interval, or a single window, begins
        low = np.repeat(np.minimum.reduceat(low, interval), np.diff(np.r_[interval, len(low)]))
    out, from_b = [], rows >= len(a.symbols)
    for side, t, skip in ((~from_b, a, 0), (from_b, b, len(a.symbols))):
        string, offset, size = t.places
        counts, own = np.maximum(size - length + 1, 0), rows[side] - skip
        found = np.empty(int(counts.sum()), np.int64)
        found[(np.cumsum(counts) - counts)[string[own]] + offset[own]] = low[side]
        out.append((counts, found))
    return out


def gather(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at start and have n elements, one run after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def shard_transforms(packed: DataFrame, units: int, pieces: int) -> DataFrame:
    """(batch, unit, shard, data): per unit and shard the transforms of its pieces, their strings' first documents, and which batch has which strings; rows with unit -1 pass as they are."""
    columns = ["batch", "unit", "shard", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(unit: int, shard: int, held: list[tuple]) -> pa.RecordBatch:
            lengths, piece, low, content, body = (np.concatenate([x[k] for x in held]) for k in range(2, 7))
            lengths = lengths.astype(np.int64)
            _, first, which = np.unique(content, return_index=True, return_inverse=True)
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, which, low)
            piece = piece[first]
            by_piece = np.argsort(piece, kind="stable")
            cut = np.searchsorted(piece[by_piece], np.arange(pieces + 1))
            start = np.cumsum(lengths) - lengths
            symbols, order = [], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own = by_piece[lo:hi]
                n = lengths[first[own]]
                found, names = shard_symbols(body[gather(start[first[own]], n)], n)
                symbols.append(found)
                order.append(own[names])
            order = np.concatenate(order)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            counts = np.array([len(x[2]) for x in held], np.int64)
            arrays = (np.array([len(x) for x in symbols], np.int64), np.concatenate(symbols).astype(np.uint8), least[order], np.array([x[0] for x in held], np.int64), np.array([x[1][0] for x in held], np.int64), counts, place[which].astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([unit]), pa.array([shard], pa.int32()), pa.array([frame(*arrays)], pa.binary())], columns)

        now, held = None, []
        for b in batches:
            for batch, both, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if both == -1:
                    yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([-1]), pa.nulls(1, pa.int32()), pa.array([data.as_py()], pa.binary())], columns)
                    continue
                unit, shard = divmod(both, 2)
                if (unit, shard) != now:
                    if held:
                        yield done(*now, held)
                    now, held = (unit, shard), []
                held.append((batch, *unframe(data.as_buffer())))
        if held:
            yield done(*now, held)

    dealt = packed.repartition(2 * units, F.when(F.col("unit") < 0, F.xxhash64("batch")).otherwise(F.col("unit")))
    return dealt.sortWithinPartitions("unit").mapInArrow(tidy(run), "batch long, unit long, shard int, data binary")


def decided_stretches(transforms: DataFrame, units: int, pieces: int, length: int = LENGTH) -> DataFrame:
    """(batch, data): per unit and batch the smallest first document of every window of the batch's stretches there, from the merged transforms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = [np.zeros(pieces, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)]

        def done(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
            sides = [held.get(k, nothing) for k in (0, 1)]
            at, named, found = [0, 0], [0, 0], ([], [])
            for piece in range(pieces):
                shards, first = [], []
                for k, (sizes, symbols, low, *_) in enumerate(sides):
                    t = ShardTransform(symbols[at[k] : at[k] + sizes[piece]])
                    shards.append(t)
                    first.append(low[named[k] : named[k] + t.strings])
                    at[k] += int(sizes[piece])
                    named[k] += t.strings
                if len(shards[0].symbols) + len(shards[1].symbols):
                    for k, x in enumerate(first_documents(*shards, tuple(first), length)):
                        found[k].append(x)
            names, blobs = [], []
            for k, own in held.items():
                counts, values = (np.concatenate([x[i] for x in found[k]]) for i in (0, 1))
                start = np.cumsum(counts) - counts
                batch, place, n, which = own[3:]
                for i, (lo, hi) in enumerate(zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist(), strict=True)):
                    ref = which[lo:hi]
                    names.append(int(batch[i]))
                    blobs.append(frame(place[i : i + 1], counts[ref], values[gather(start[ref], counts[ref])]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["batch", "data"])

        now, held = None, {}
        for b in batches:
            for unit, shard, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if unit != now:
                    if held:
                        yield done(held)
                    now, held = unit, {}
                held[shard] = unframe(data.as_buffer())
        if held:
            yield done(held)

    return transforms.repartition(units, "unit").sortWithinPartitions("unit").mapInArrow(tidy(run), "batch long, data binary")


def removal_marks(texts: DataFrame, text_bytes: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, marks): per document the removed windows, as packed (at, bits) of its stretches; documents must be distinct texts.

    texts has doc_id and text, of text_bytes or less in all.
    """
    spark = texts.sparkSession
    shared = stage(shared_anchors(texts, text_bytes), "anchors")
    size = STRETCH_BYTES * shared.count()
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // UNIT_BYTES))
    pieces = max(1, -(-size // (units * PIECE_BYTES)))
    hot = shared.filter("doc_id is null").orderBy(F.desc("documents"), "anchor").limit(MOST_HOT).select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(np.uint64)
    # Steps are written one by one, so that what each shuffles goes before the next one begins.
    transforms = stage(shard_transforms(packed_stretches(compressed(texts), shared, hot, units, pieces, length), units, pieces), "transforms")
    drop(shared)
    decided = decided_stretches(transforms.filter("unit >= 0").select("unit", "shard", "data"), units, pieces, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(own: tuple, parts: list[tuple]) -> pa.RecordBatch:
            which, doc, at, windows = own
            parts.sort(key=lambda x: int(x[0][0]))
            count, first = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
            begin = np.cumsum(count) - count
            # Every window of every occurrence: is its first document smaller than this one?
            step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            gone = first[np.repeat(begin[which], windows) + step] < np.repeat(doc, windows)
            bits = np.add.reduceat(gone.astype(np.int64) << step, np.cumsum(windows) - windows)
            keep = bits != 0
            doc, at, bits = doc[keep], at[keep], bits[keep]
            order = np.argsort(doc, kind="stable")
            doc, at, bits = doc[order], at[order], bits[order]
            lo = run_starts(doc)
            hi = np.r_[lo[1:], len(doc)][: len(lo)]  # none if nothing of the batch goes
            marks = [np.stack([at[s:e], bits[s:e]]).tobytes() for s, e in zip(lo.tolist(), hi.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(doc[lo]), pa.array(marks, pa.binary())], ["doc_id", "marks"])

        now, own, parts = None, None, []
        for b in batches:
            for batch, unit, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if batch != now:
                    if own is not None:
                        yield done(own, parts)
                    now, own, parts = batch, None, []
                value = unframe(data.as_buffer())
                if unit == -1:
                    own = value
                else:
                    parts.append(value)
        if own is not None:
            yield done(own, parts)

    both = transforms.filter("unit = -1").select("batch", "unit", "data").unionByName(decided.select("batch", F.lit(0).cast("long").alias("unit"), "data"))
    back = both.repartition("batch").sortWithinPartitions("batch").mapInArrow(tidy(run), "doc_id long, marks binary")
    # A repeated row may stand in two batches; its marks are equal there.
    marks = stage(back.groupBy("doc_id").agg(F.first("marks").alias("marks")), "marks")
    drop(transforms)
    return marks


def removed_bytes(n: int, at: np.ndarray, bits: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes the marked windows cover."""
    some, which = np.nonzero((bits[:, None] >> np.arange(MOST_WINDOWS)) & 1)
    start = at[some] + which
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n): each text's digest and bytes."""
    return docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))


def copies_of(digests: DataFrame) -> DataFrame:
    """doc_id of every document whose whole text a smaller doc_id has. The first ones are written before the join, so that large groups of copies can be split."""
    first = digests.groupBy("digest", "n").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc").drop("last_doc")
    return digests.join(stage(first, "firsts"), ["digest", "n"]).filter("doc_id > first_doc").select("doc_id").distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with its text compressed (packed), packed marks (null if no passage goes) and is_copy; the other columns stay."""
    docs = docs.drop("marks", "is_copy", "packed")
    digest = stage(text_digests(docs), "digests")
    copies = stage(copies_of(digest), "copies")
    text_bytes = digest.agg(F.sum("n")).first()[0] or 0
    drop(digest)
    texts = docs.filter(F.octet_length("text") >= length).select("doc_id", "text").join(copies, "doc_id", "left_anti")
    marks = removal_marks(texts, text_bytes, length).withColumn("is_copy", F.lit(False))
    copied = copies.select("doc_id", F.lit(None).cast("binary").alias("marks"), F.lit(True).alias("is_copy"))
    return compressed(docs).join(marks.unionByName(copied), "doc_id", "left")


def removed_of(raw: np.ndarray, marks: bytes | None, is_copy: bool | None, length: int) -> np.ndarray:
    """Which bytes of one text are removed."""
    if is_copy:
        return np.full(len(raw), len(raw) >= length)
    if not marks:
        return np.zeros(len(raw), bool)
    at, bits = np.frombuffer(marks, np.int64).reshape(2, -1)
    return removed_bytes(len(raw), at, bits, length)


def _rows(b: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    press = zstandard.ZstdDecompressor()
    for packed, marks, copy in zip(b.column("packed"), b.column("marks"), b.column("is_copy").to_pylist(), strict=True):
        raw = np.frombuffer(press.decompress(packed.as_py()) if packed.is_valid else b"", np.uint8)
        yield raw, removed_of(raw, marks.as_py(), copy, length)


def digests(marked: DataFrame, length: int = LENGTH) -> DataFrame:
    """What was removed and the digest of what is left, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, spans, sha = [], [], [], []
            for raw, gone in _rows(b, length):
                n.append(len(raw))
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                sha.append(hashlib.sha256(raw[~gone].tobytes() if removed[-1] else raw.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select("doc_id", "packed", "marks", "is_copy").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, with their columns, without the repeated passages; characters that a passage cuts through stay whole.

    n_chars, where there is one, follows the text. Rows of which nothing but white space is left go.
    """
    docs = docs.drop("marks", "is_copy", "packed")
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, stay, changed = [], [], []
            for valid, (raw, gone) in zip(b.column("packed").is_valid().to_pylist(), _rows(b, length), strict=True):
                cut = bool(gone.any())
                if cut:
                    head = (raw & 0xC0) != 0x80
                    raw = raw[~np.logical_and.reduceat(gone, np.flatnonzero(head))[np.cumsum(head) - 1]]
                texts.append(raw.tobytes().decode() if valid else None)
                changed.append(cut)
                stay.append(not cut or bool(texts[-1].strip()))
            own = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                own["n_chars"] = pa.array([len(t) if c else n for n, t, c in zip(b.column("n_chars").to_pylist(), texts, changed, strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([own[c] if c in own else b.column(c) for c in names], names).filter(pa.array(stay, pa.bool_()))

    return remove_repeats(docs, length).mapInArrow(tidy(run), schema)


def op2_bwt_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(remove_repeats(docs))

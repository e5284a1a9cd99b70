"""Vectorised byte-level helpers that run inside Spark tasks on Arrow batches.

A column of texts is viewed as one flat byte array plus row offsets, in chunks
of bounded size, so that hashing, word splitting and window scans are a few
numpy passes instead of a Python loop over characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U64 = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def give_back_memory() -> None:
    """Returns freed memory to the system: workers stay between tasks, beside their executor's JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on all input bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) over runs of whole rows of about `limit` bytes."""
    flat, off = string_parts(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, flat[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have about `least` bytes, for work that gains from many rows at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; grown on demand and kept up to one chunk."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


class Words:
    """Words of a flat chunk: start and end byte, row, and a 64-bit hash."""

    def __init__(self, flat: np.ndarray, off: np.ndarray, lower: bool = True, space: np.ndarray = SPACE):
        self.flat = LOWER[flat] if lower else flat
        n = len(flat)
        self.rows = len(off) - 1
        blank = space[flat] if n else np.zeros(0, bool)
        first = np.zeros(n + 1, bool)
        first[off] = True
        start = ~blank
        start[1:] &= blank[:-1] | first[1:n]
        end = ~blank
        end[:-1] &= blank[1:] | first[1:n]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.row = np.searchsorted(off, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self._sum: np.ndarray | None = None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sum is None:
            n = len(self.flat)
            self._sum = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_CODE[self.flat] * powers(BASE, n), out=self._sum[1:])
        inverse = powers(BASE_INVERSE, len(self.flat) + 1)
        return mix((self._sum[end] - self._sum[start]) * inverse[start])

    @property
    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def rolling(flat: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of a flat array, built by doubling; 64-bit values are taken as codes of symbols."""
    if len(flat) < k:
        return np.zeros(0, np.uint64)
    cur, cl, res, rl = flat if flat.dtype == np.uint64 else BYTE_CODE[flat], 1, None, 0
    left = k
    while left:
        if left & 1:
            if res is None:
                res, rl = cur, cl
            else:
                n = len(flat) - (rl + cl) + 1
                res = res[:n] * U64(pow(BASE, cl, 2**64)) + cur[rl : rl + n]
                rl += cl
        left >>= 1
        if left:
            n = len(flat) - 2 * cl + 1
            cur = cur[:n] * U64(pow(BASE, cl, 2**64)) + cur[cl : cl + n]
            cl *= 2
    return mix(res)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` neighbours."""
    if len(values) < width:
        return values[:0]
    out, s = values, 1
    while s * 2 <= width:
        out = np.minimum(out[:-s], out[s:])
        s *= 2
    if s < width:
        out = np.minimum(out[: len(out) - (width - s)], out[width - s :])
    return out


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first element of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])

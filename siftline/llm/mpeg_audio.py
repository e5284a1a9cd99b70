"""MPEG audio column: frame writer, resynchronising frame reader, durations and seek offsets.

The reader walks a byte string as an MPEG-1/2/2.5 audio stream: it skips ID3v2
and APE tags at the front and ID3v1 at the end, finds frame headers (a sync is
believed only if a frame of the same kind, or the end, follows or precedes it), recovers after
garbage by scanning for the next such sync, reads Xing, Info and VBRI tables,
verifies each protected frame's CRC-16, and keeps the exact duration in samples
and the byte offset of every frame.

The writer stores a payload losslessly in the main-data area of layer III frames,
192 bytes a frame, with CRCs, an ID3v2 tag that keeps the unpadded length, and a
Xing table of the variable bit rates.

Cases: a null text is the empty payload, which is padded to one 192-byte unit
like any other; repeated texts give equal media; extra columns of the input are
not read; an empty table gives an empty result. A damaged stream yields the frames
that can be found, with `lost_bytes` and `crc_bad` saying what was wrong.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table

UNIT = 192
# Fixed values of the public MPEG audio header format: kbit/s by (version 1 or 2, layer), Hz by version.
KBPS = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    hertz: int
    mono: bool
    length: int
    samples: int

    @property
    def side_info(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def read_header(word: int) -> Header | None:
    """The frame header in a 32-bit word, or None if the word can't be one (free format counts as none)."""
    if word >> 21 != 0x7FF:
        return None
    version, layer_bits, bits, rate = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer_bits == 0 or bits in (0, 15) or rate == 3:
        return None
    layer, first = 4 - layer_bits, version == 3
    kbps, hertz, pad = KBPS[(1 if first else 2, layer)][bits], HERTZ[version][rate], word >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + pad
    return Header(version, layer, not word >> 16 & 1, kbps, hertz, word >> 6 & 3 == 3, length, samples)


_CACHE: dict[int, Header | None] = {}


def header_at(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data):
        return None
    word = int.from_bytes(data[at : at + 4], "big")
    if word not in _CACHE:
        if len(_CACHE) > 50_000:
            _CACHE.clear()
        _CACHE[word] = read_header(word)
    return _CACHE[word]


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out[i] = c
    return out


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (0x8005, start 0xFFFF) of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)  # of a Xing, Info or VBRI frame
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    lost_bytes: int = 0
    resyncs: int = 0
    crc_ok: int = 0
    crc_bad: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration_us(self) -> int:
        """Exact to the microsecond: samples are summed by sample rate before dividing."""
        by: dict[int, int] = {}
        for h in self.headers:
            by[h.hertz] = by.get(h.hertz, 0) + h.samples
        return sum(n * 1_000_000 // hz for hz, n in by.items())


def syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_tags(data: bytes, tags: dict[str, str]) -> tuple[int, int]:
    """Where the audio starts and ends; fills tags from ID3v2 text frames and ID3v1."""
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = syncsafe(data[at + 6 : at + 10])
        p, stop, v4 = at + 10, min(end, at + 10 + size), data[at + 3] >= 4
        while p + 10 <= stop and data[p : p + 4].strip(b"\0"):
            n = syncsafe(data[p + 4 : p + 8]) if v4 else int.from_bytes(data[p + 4 : p + 8], "big")
            body = data[p + 10 : p + 10 + n]
            if data[p : p + 1] == b"T" and body:
                text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace").strip("\0")
                key, _, value = text.partition("\0")
                tags[f"TXXX:{key}" if data[p : p + 4] == b"TXXX" else data[p : p + 4].decode("latin-1")] = value if data[p : p + 4] == b"TXXX" else text
            p += 10 + n
        at += 10 + size + (10 if data[at + 5] & 0x10 else 0)
    if data[at : at + 8] == b"APETAGEX" and at + 32 <= end:
        at += 32 + int.from_bytes(data[at + 12 : at + 16], "little")
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags["ID3v1"] = data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    return min(at, end), end


def read_table(frame: bytes, h: Header) -> dict:
    """The seek table of a first frame: {'kind', 'frames', 'bytes', 'toc'} or {}."""
    at = 4 + (2 if h.protected else 0) + h.side_info
    for p in dict.fromkeys((at, 4 + h.side_info)):
        kind = frame[p : p + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= p + 8:
            flags, p, out = int.from_bytes(frame[p + 4 : p + 8], "big"), p + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, count, entries, scale, width = (int.from_bytes(frame[a:b], "big") for a, b in ((46, 50), (50, 54), (54, 56), (56, 58), (58, 60)))
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": count, "bytes": size, "toc": toc}
    return {}


def read_stream(data: bytes) -> Stream:
    """Walk a whole stream. Offsets and headers leave out the frame that only carries the seek table."""
    s = Stream()
    at, end = read_tags(data, s.tags)
    synced, first, last = False, True, None
    while at < end:
        h = header_at(data, at)
        after = at + h.length if h else 0
        alike = lambda n: n is not None and (n.version, n.layer, n.hertz) == (h.version, h.layer, h.hertz)  # noqa: E731, B023
        good = h is not None and after <= end and (synced and alike(last) or after == end or alike(header_at(data, after)))
        if not good:
            jump = data.find(b"\xff", at + 1, end)
            jump = end if jump < 0 else jump
            s.lost_bytes += jump - at
            s.resyncs += synced
            synced, at = False, jump
            continue
        synced, last = True, h
        if first:
            s.table = read_table(data[at:after], h)
        if not (first and s.table):
            s.offsets.append(at)
            s.headers.append(h)
        first, at = False, after
    flat = np.frombuffer(data, np.uint8)
    offsets = np.array(s.offsets, np.int64)
    for side in {h.side_info for h in s.headers if h.protected and h.layer == 3}:
        own = offsets[[h.protected and h.layer == 3 and h.side_info == side for h in s.headers]]
        covered = np.concatenate([flat[own[:, None] + np.arange(2, 4)], flat[own[:, None] + np.arange(6, 6 + side)]], axis=1)
        stored = flat[own + 4].astype(np.uint16) << np.uint16(8) | flat[own + 5]
        ok = int((crc16(covered) == stored).sum())
        s.crc_ok += ok
        s.crc_bad += len(own) - ok
    return s


# The writer's frames: MPEG-1 layer III, 48 kHz mono, protected; two bit rates, so the stream is variable.
LOW, HIGH = 0xFFFA0000 | 6 << 12 | 1 << 10 | 3 << 6, 0xFFFA0000 | 7 << 12 | 1 << 10 | 3 << 6
BODY = 4 + 2 + 17


def text_tag(name: bytes, value: str) -> bytes:
    body = b"\3" + value.encode()
    size = bytes(len(body) >> s & 127 for s in (21, 14, 7, 0))
    return name + size + b"\0\0" + body


def write_stream(payload: bytes, n_bytes: int) -> bytes:
    """A payload, whose length is a multiple of UNIT, as a tagged variable-bitrate stream."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(units)
    high = np.arange(n) % 8 == 7
    length = np.where(high, 288, 240)
    start = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(int(start[-1]), np.uint8)
    for word, rows in ((LOW, np.flatnonzero(~high)), (HIGH, np.flatnonzero(high))):
        if len(rows):
            head = np.zeros((len(rows), BODY + UNIT), np.uint8)
            head[:, :4] = np.frombuffer(struct.pack(">I", word), np.uint8)
            crc = crc16(np.concatenate([head[:1, 2:4], head[:1, 6:BODY]], axis=1))[0]
            head[:, 4], head[:, 5] = crc >> 8, crc & 255
            head[:, BODY:] = units[rows]
            out[start[rows][:, None] + np.arange(BODY + UNIT)] = head
    total = int(start[-1])
    toc = bytes(int(start[min(n - 1, i * n // 100)]) * 256 // max(total, 1) for i in range(100))
    first = bytearray(288)
    first[:4] = struct.pack(">I", HIGH)
    crc = crc16(np.frombuffer(bytes(first[2:4]) + bytes(17), np.uint8)[None, :])[0]
    first[4:6] = struct.pack(">H", int(crc))
    first[BODY : BODY + 116] = b"Xing" + struct.pack(">III", 7, n, total + 288) + toc
    frames = text_tag(b"TLEN", str(n * 24)) + text_tag(b"TXXX", f"n_bytes\0{n_bytes}")
    tag = b"ID3\4\0\0" + bytes(len(frames) >> s & 127 for s in (21, 14, 7, 0)) + frames
    return tag + bytes(first) + out.tobytes()


def stored_payload(data: bytes, s: Stream) -> bytes:
    """What write_stream stored, from the frames that were found."""
    if not s.offsets:
        return b""
    flat = np.frombuffer(data, np.uint8)
    return flat[np.array(s.offsets)[:, None] + np.arange(BODY, BODY + UNIT)].tobytes()


def padded(raw: bytes) -> bytes:
    n = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw + b" " * (n - len(raw))


def encode_column(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, media): each whole text as an MPEG stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, len(b), 256):
                raws = [(t.as_py() or "").encode() for t in texts.slice(at, 256)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array([write_stream(padded(r), len(r)) for r in raws], pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_us long, crc_ok long, crc_bad long, lost_bytes long, seek_offsets array<long>"


def media_features(media: DataFrame, seek_every: int = 42) -> DataFrame:
    """(doc_id, media) -> what the stored bytes say: payload digests, durations, checks and a seek offset about every second."""

    def row(doc_id: int, data: bytes) -> dict:
        s = read_stream(data)
        payload = stored_payload(data, s)
        seek = s.offsets[::seek_every]
        rates = [h.kbps for h in s.headers] or [0]
        where = hashlib.sha1(np.array(s.offsets, np.int64).tobytes()).hexdigest()[:12]
        feature = f"frames={len(s.offsets)};us={s.duration_us};kbps={min(rates)}-{max(rates)};table={s.table.get('kind', '-')}:{s.table.get('frames', 0)};crc={s.crc_ok}/{s.crc_ok + s.crc_bad};lost={s.lost_bytes};offsets={where}"
        return {
            "doc_id": doc_id, "n_bytes": int(s.tags.get("TXXX:n_bytes", 0)), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
            "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature, "n_frames": len(s.offsets), "duration_us": s.duration_us, "crc_ok": s.crc_ok, "crc_bad": s.crc_bad, "lost_bytes": s.lost_bytes, "seek_offsets": seek,
        }

    kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in FEATURES.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pylist([row(i, (m.as_py() or b"")) for i, m in zip(ids, b.column(1), strict=True)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media_features(encode_column(docs))

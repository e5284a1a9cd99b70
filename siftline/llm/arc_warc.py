"""Legacy ARC archives to WARC: reader for both header versions, converter, revisit records, read-back.

An ARC file starts with a version block (a filedesc: line whose body names the
fields of version 1 or 2), then records: one header line, then as many bytes as
the line declares. Only declared lengths delimit records, so bodies may hold
anything. The converter synthesises for each record a stable record id, a WARC
timestamp, the type, and the SHA-1 digest of the payload; the reader adds that of each block.

Archives are written with Spark's text sink, whose line separator is the record
terminator of the format, so any file system Spark can write will do; they are
read back with the binaryFile source and parsed by declared lengths.

Cases: null html is an empty payload (length 0, still a record, and equal to other
empty payloads); null or odd urls are percent-encoded, an absent one is "-"; of
repeated page ids each row gives a record (equal rows are responses alike if they are the
largest); very large pages are segments of their own, and files are bounded by bytes; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import IO, NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, table

# The field names of the two public ARC record header versions.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
SEGMENT_PAGES, SEGMENT_BYTES = 64, 8 << 20  # of one ARC segment; a page beyond is a segment of its own
FILE_SEGMENTS = 64
FILE_BYTES = 1 << 30  # of a WARC file before compression
FILE_RECORDS = 5000
FIRST_CAPTURE = datetime(2004, 1, 1, tzinfo=timezone.utc)
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")
CRLF = "\r\n"


class Record(NamedTuple):
    version: int
    fields: dict[str, str]
    block: bytes


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "-"


def arc_segment(name: str, version: int, records: list[tuple[str, str, bytes]]) -> bytes:
    """A version block and records of (url, 14-digit date, block)."""
    about = f"{version} 0 Example\n{' '.join(FIELDS[version])}\n\n"
    if version == 1:
        parts = [f"filedesc://{name} 0.0.0.0 {FIRST_CAPTURE:%Y%m%d%H%M%S} text/plain {len(about)}\n{about}".encode()]
    else:
        parts = [f"filedesc://{name} 0.0.0.0 {FIRST_CAPTURE:%Y%m%d%H%M%S} text/plain 200 - - 0 {name} {len(about)}\n{about}".encode()]
    at = len(parts[0])
    for url, date, block in records:
        if version == 1:
            line = f"\n{safe_url(url)} 192.0.2.1 {date} text/html {len(block)}\n"
        else:
            line = f"\n{safe_url(url)} 192.0.2.1 {date} text/html 200 {hashlib.md5(block).hexdigest()} - {at} {name} {len(block)}\n"
        parts += [line.encode(), block]
        at += len(parts[-2]) + len(block)
    return b"".join(parts)


def read_arc(stream: IO[bytes]) -> Iterator[Record]:
    """Records of one or several concatenated ARC files, by declared lengths; version blocks switch the field list."""
    version, names = 1, FIELDS[1]
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        length = int(parts[-1])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"record of {parts[0]!r} declares {length} bytes, {len(block)} are left")
        if parts[0].startswith("filedesc:"):
            head = block.split(b"\n", 2)
            version = int(head[0].split(b" ")[0])
            names = head[1].decode().split(" ") if len(head) > 1 and head[1].strip() else FIELDS.get(version, FIELDS[1])
            continue
        if len(parts) != len(names):  # a url with spaces, as some old crawlers wrote
            parts = [" ".join(parts[: len(parts) - len(names) + 1]), *parts[len(parts) - len(names) + 1 :]]
        yield Record(version, dict(zip(names, parts, strict=True)), block)


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return {}, block
    lines = head.decode("latin-1").split(CRLF)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def warc_time(date: str) -> str:
    """ARC dates have 14 digits, or 12 in some old files."""
    d = datetime.strptime(date.ljust(14, "0"), "%Y%m%d%H%M%S")
    return d.strftime("%Y-%m-%dT%H:%M:%SZ")


def convert(r: Record) -> dict:
    """What the equivalent WARC record says."""
    http, payload = split_http(r.block)
    digest = sha1_base32(payload)
    when = warc_time(r.fields["Archive-date"])
    page = http.get("x-page-id", "")
    return {
        "page_id": int(page) if page else None, "url": unquote(r.fields["URL"]), "arc_version": r.version, "warc_date": when, "mime": r.fields["Content-type"],
        "record_id": f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{r.fields["URL"]} {when} {digest} {page}')}", "payload_bytes": len(payload), "payload_digest": digest, "payload": payload.decode("utf-8"),
    }


CONVERTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("arc_version", pa.int32()), ("warc_date", pa.string()), ("mime", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])
CONVERTED_DDL = "page_id long, url string, arc_version int, warc_date string, mime string, record_id string, payload_bytes long, payload_digest string, payload string"


def write_arc(pages: DataFrame, path: str) -> None:
    """Pages as gzipped ARC files of segments in both header versions, in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, records, size = 0, [], 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([arc_segment(f"segment-{turn}.arc", 1 + turn % 2, records).decode()])], ["value"])

        for b in batches:
            for at in range(0, len(b), SEGMENT_PAGES):
                for page in b.slice(at, SEGMENT_PAGES).to_pylist():
                    body = (page["html"] or "").encode()
                    if records and (len(records) == SEGMENT_PAGES or size + len(body) > SEGMENT_BYTES):
                        turn += 1
                        yield segment()
                        records, size = [], 0
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'' if page['page_id'] is None else page['page_id']}\r\n\r\n"
                    date = (FIRST_CAPTURE + timedelta(seconds=(page["page_id"] or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                    records.append((page["url"], date, head.encode() + body))
                    size += len(body)
        if records:
            turn += 1
            yield segment()

    pages.select("page_id", "url", "html").mapInArrow(run, "value string").write.option("maxRecordsPerFile", FILE_SEGMENTS).option("compression", "gzip").text(path)


def _unzipped(content: bytes) -> IO[bytes]:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def convert_arc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the ARC files under a path, with their synthesised WARC fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for r in read_arc(_unzipped(content.as_py())):
                    rows.append(convert(r))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=CONVERTED)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=CONVERTED)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, CONVERTED_DDL)


def with_revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """Adds refers_to and refers_to_id: of records with equal payloads of at least `least` bytes the largest page_id is the response.

    Digest groups are aggregated before the shuffle; the join back is one that
    Spark can split when a digest is hot.
    """
    first = (
        records.filter(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("g_digest"), F.col("payload_bytes").alias("g_bytes"))
        .agg(F.max(F.struct("page_id", "record_id")).alias("kept"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    joined = records.join(first, (F.col("payload_digest") == F.col("g_digest")) & (F.col("payload_bytes") == F.col("g_bytes")), "left")
    older = F.col("kept").isNotNull() & ~F.col("kept.record_id").eqNullSafe(F.col("record_id"))
    return joined.withColumns({"refers_to": F.when(older, F.col("kept.page_id")), "refers_to_id": F.when(older, F.col("kept.record_id"))}).drop("kept", "n", "g_digest", "g_bytes")


def write_warc(records: DataFrame, path: str, most_records: int = FILE_RECORDS) -> None:
    """Response and revisit records as gzipped WARC/1.1 files; a record ends where a text line does."""
    nl = F.lit(CRLF)
    revisit = F.col("refers_to_id").isNotNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK"), nl, F.lit("Content-Type: "), "mime", F.lit("; charset=utf-8"), nl, F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), nl, F.lit("X-Page-Id: "), page, nl, nl)
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    named = F.concat(
        F.lit("WARC/1.1"), nl, F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), nl,
        F.lit("WARC-Record-ID: <"), "record_id", F.lit(">"), nl, F.lit("WARC-Date: "), "warc_date", nl, F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "), nl,
        F.lit("WARC-Payload-Digest: sha1:"), "payload_digest", nl,
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), nl, F.lit("WARC-Refers-To: <"), "refers_to_id", F.lit(">"), nl, F.lit("X-Refers-To-Page: "), F.col("refers_to").cast("string"), nl)).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response"), nl, F.lit("Content-Length: "), F.octet_length(block).cast("string"), nl, nl, block,
    )
    records.select(named.alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", most_records).option("compression", "gzip").text(path)


def read_warc_stream(stream: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"expected a WARC record, found {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head["content-length"]))


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("warc_date", pa.string()), ("block_digest", pa.string())])
READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, block_digest string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record; a response whose payload doesn't have its digest is an error."""

    def row(head: dict[str, str], block: bytes) -> dict:
        http, payload = split_http(block)
        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
        if kind == "response" and sha1_base32(payload) != digest:
            raise ValueError(f"payload of {head['warc-record-id']} doesn't have its digest")
        page, other = http.get("x-page-id"), head.get("x-refers-to-page")
        return {"page_id": int(page) if page else None, "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": int(other) if other else None, "record_id": head["warc-record-id"].strip("<>"), "warc_date": head["warc-date"], "block_digest": sha1_base32(block)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield pa.RecordBatch.from_pylist([row(*x) for x in read_warc_stream(_unzipped(content.as_py()))], schema=READ)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, READ_DDL)


def pages_to_warc(pages: DataFrame, least: int = 0) -> str:
    """Pages through legacy ARC files into WARC files; returns the folder of the WARC files."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    write_warc(with_revisits(convert_arc(spark, arc), least), warc, max(1, min(FILE_RECORDS, FILE_BYTES // (longest + 4096))))
    return warc


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_warc(spark, pages_to_warc(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
d AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
             + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM m
"""

"""Landed feed documents as a Spark data source: polls and their RSS or Atom entries, in batch and as a stream.

A fetcher (outside) lands every answer of a feed server as one file, named after the poll
(see `landed_name`), so listing a folder tells who was asked when, with which status and ETag, without
opening anything. The stream's offset is the last file's name with the last ETag of every
source; a document whose ETag its source had before is an unchanged poll, as a 304 is, and isn't read. Files
are split among partitions; executors parse them. Folders may be on any file system that pyarrow knows.

    spark.dataSource.register(FeedDocuments)
    spark.read.format("feed_documents").load(folder)

One row per poll (place null) and one per entry (place from 0). A document that breaks off gives the entries before
the break and an error in its poll row; entries without a link are counted by place but left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import quote, unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_id string, polled_at long, status int, etag string, not_modified boolean, place int, link string, title string, body string, publisher string, published string, updated string, error string"
FILES_A_PART = 64


class Landed(NamedTuple):
    name: str
    polled_at: int
    source_id: str
    status: int
    etag: str


def landed_name(polled_at: int, source_id: str, status: int, etag: str | None) -> str:
    """Names sort by time, then source."""
    return f"{int(polled_at):012d},{quote(str(source_id), safe='')},{int(status)},{quote(etag or '', safe='')}.xml"


def parsed_name(name: str) -> Landed | None:
    parts = name.removesuffix(".xml").split(",")
    if not name.endswith(".xml") or len(parts) != 4 or not (parts[0].isdigit() and parts[2].isdigit()):
        return None
    return Landed(name, int(parts[0]), unquote(parts[1]), int(parts[2]), unquote(parts[3]))


def folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listing(path: str) -> list[Landed]:
    fs, base = folder(path)
    names = (parsed_name(f.base_name) for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.is_file)
    return sorted((n for n in names if n), key=lambda n: n.name)


def judged(files: Iterable[Landed], etags: dict[str, str]) -> list[tuple[Landed, bool]]:
    """Each file with whether its document is unchanged; etags, the last one of every source, is brought up to date."""
    out = []
    for f in files:
        same = f.status == 304 or f.status == 200 and bool(f.etag) and etags.get(f.source_id) == f.etag
        if f.status == 200:
            etags[f.source_id] = f.etag
        out.append((f, same))
    return out


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def entry_of(node: ElementTree.Element) -> dict[str, str]:
    """The fields of an RSS item or an Atom entry."""
    texts: dict[str, str] = {}
    link = publisher = ""
    for child in node.iter():
        name, text = local(child.tag), "".join(child.itertext()).strip()
        if name == "link" and child.get("rel", "alternate") == "alternate":
            link = link or child.get("href", "").strip() or text
        elif name == "source":
            publisher = next((("".join(t.itertext())).strip() for t in child if local(t.tag) == "title"), (child.text or "").strip())
        elif child is not node:
            texts.setdefault("media" if "search.yahoo.com/mrss" in child.tag and name == "description" else name, text)
    first = lambda *names: next((texts[n] for n in names if texts.get(n)), "")
    return {"link": link, "title": first("title"), "body": first("media", "summary", "description", "encoded", "content"), "publisher": publisher, "published": first("pubdate", "published", "date"), "updated": first("updated", "modified")}


def parse_feed(data: bytes) -> tuple[list[dict[str, str]], str | None]:
    """The entries of a document in order, and what broke it off, if anything did."""
    parser, found = ElementTree.XMLPullParser(["end"]), []
    try:
        parser.feed(data)
        parser.close()
    except ElementTree.ParseError as e:
        error = str(e)
    else:
        error = None
    try:
        for _, node in parser.read_events():
            if local(node.tag) in ("item", "entry"):
                found.append(entry_of(node))
    except ElementTree.ParseError as e:
        error = error or str(e)
    return found, error


@dataclass
class Files(InputPartition):
    path: str
    files: list[tuple[Landed, bool]]


def split(path: str, files: list[tuple[Landed, bool]], size: int) -> list[Files]:
    return [Files(path, files[k : k + size]) for k in range(0, len(files), size)] or [Files(path, [])]


def rows(part: Files) -> Iterator[tuple]:
    fs, base = folder(part.path)
    for f, same in part.files:
        entries, error = [], None
        if f.status == 200 and not same:
            with fs.open_input_stream(f"{base.rstrip('/')}/{f.name}") as stream:
                entries, error = parse_feed(stream.read())
        elif f.status not in (200, 304):
            error = f"HTTP {f.status}"
        head = (f.source_id, f.polled_at, f.status, f.etag or None, same)
        yield *head, None, None, None, None, None, None, None, error
        for place, e in enumerate(entries):
            if e["link"]:
                yield *head, place, *(e[k] or None for k in ("link", "title", "body", "publisher", "published", "updated")), None


class FeedBatch(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> Sequence[Files]:
        return split(self.path, judged(listing(self.path), {}), self.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition)


class FeedStream(DataSourceStreamReader):
    """Offset: {after: the last file's name, etags: the last ETag by source}."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.known = {"after": "", "etags": {}}

    def initialOffset(self) -> dict:
        return {"after": "", "etags": {}}

    def latestOffset(self) -> dict:
        etags = dict(self.known["etags"])
        new = [f for f in listing(self.path) if f.name > self.known["after"]]
        judged(new, etags)
        self.known = {"after": new[-1].name if new else self.known["after"], "etags": etags}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> Sequence[Files]:
        between = [f for f in listing(self.path) if start["after"] < f.name <= end["after"]]
        return split(self.path, judged(between, dict(start["etags"])), self.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition)

    def commit(self, end: dict) -> None:
        """Files stay: retention is the landing folder's own matter."""


class FeedDocuments(DataSource):
    """Options: path (given to load), files (so many at most in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "feed_documents"

    def schema(self) -> str:
        return SCHEMA

    def _made(self, kind: type):
        return kind(self.options["path"], int(self.options.get("files", FILES_A_PART)))

    def reader(self, schema) -> FeedBatch:
        return self._made(FeedBatch)

    def streamReader(self, schema) -> FeedStream:
        return self._made(FeedStream)


def land(polls: DataFrame, path: str) -> int:
    """Writes rows (polled_at, source_id, status, etag, body) as landed files, from the executors; a file is named by its poll, so a repeated task writes the same."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = folder(path)
        fs.create_dir(base, recursive=True)
        for p in parts:
            for r in p.to_dict("records"):
                target = f"{base.rstrip('/')}/{landed_name(r['polled_at'], r['source_id'], r['status'], r['etag'])}"
                with fs.open_output_stream(f"{target}.part") as out:
                    out.write((r["body"] or "").encode())
                fs.move(f"{target}.part", target)
            yield pd.DataFrame({"n": [len(p)]})

    return polls.select("polled_at", "source_id", "status", "etag", "body").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0

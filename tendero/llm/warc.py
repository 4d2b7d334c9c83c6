"""Pages written as WARC records and found again through a two-level capture index.

Archives are written where the pages lie; only the index lines are sorted. Lines of a reversed-host
key, in order, form compressed blocks in part files; a part ends with its sparse directory, one
entry a block. A look-up searches the first keys of the parts, then one directory, reads one
block and then the records it wants, each by its byte range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.llm.files import create, reader
from tendero.llm.tables import written
from tendero.llm.url_filter import PARTS, host
from tendero.llm.words import slices
from tendero.sources.shared import new_path

FILE_BYTES = 1 << 30
BLOCK_LINES = 1000
DATE = "2026-01-01T00:00:00Z"

_CAPTURE = "key string, page_id long, uri string, offset long, length long, record_type string"


def reversed_host_key(url):
    """``com,example)/path?query`` of a URL column; a null URL has the empty key."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit(""))
    back = F.concat_ws(",", F.reverse(F.split(host(url), r"\.")))
    return F.when(url.isNull(), "").when(url.rlike(PARTS), F.concat(back, F.lit(")"), rest)).otherwise(url)


def _record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def _line(value: str | None) -> str:
    """A header value on one line."""
    return json.dumps(value)[1:-1] if value and not value.isprintable() else value or ""


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, first_url: str | None) -> bytes:
    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    kind = "response" if first is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, url)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Page-ID: {'' if page_id is None else page_id}", f"Payload-Length: {len(payload)}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first, first_url)}",
                 f"WARC-Refers-To-Target-URI: {_line(first_url)}", f"Refers-To-Page-ID: {first}"]
    body = answer if first is not None else answer + payload
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers and payload of one compressed record; a revisit has no payload."""
    data = gzip.decompress(raw)
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].decode().split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = data[cut + 4:cut + 4 + int(head["Content-Length"])]
    if head["WARC-Type"] == "revisit":
        return head, None
    return head, body[body.index(b"\r\n\r\n") + 4:]


def _write(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, "", 0
        for batch in slices(batches, "html"):
            rows = []
            for key, page_id, url, html, digest, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = _record(page_id, url, (html or "").encode(), base64.b32encode(bytes.fromhex(digest)).decode(), first, first_url)
                if out and at + len(record) > FILE_BYTES:
                    out.close()
                    out = None
                if not out:
                    uri, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = create(uri)
                out.write(record)
                rows.append((key, page_id, uri, at, len(record), "response" if first is None else "revisit"))
                at += len(record)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["key", "page_id", "uri", "offset", "length", "record_type"])
        if out:
            out.close()

    return write


def write_archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Captures written for ``pages`` (``page_id``, ``url``, ``html``): key, page and byte range of each record.

    The payload is ``html`` in UTF-8; null is empty. Among equal payloads of at least ``least_bytes`` that
    of the smallest ``page_id`` is a response and others are revisits of it; all smaller payloads are responses.
    A row without id is a response and is never referred to; rows that repeat the smallest id are
    responses all. A URL may be null or no URL. Other columns are ignored; no rows write no files.
    """
    folder = new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha1(payload).alias("digest"))
    same = (rows.where(F.col("page_id").isNotNull() & (F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes)).groupBy("digest")
            .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    rows = rows.join(same, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.page_id") < F.col("page_id"))
    rows = rows.select(reversed_host_key(F.col("url")).alias("key"), "page_id", "url", "html", "digest",
                       F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_url"))
    return written(rows.mapInArrow(_write(folder), _CAPTURE), "captures")


def _index(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at, entries, lines = f"{folder}/{uuid.uuid4().hex}.cdx", None, 0, [], []

        def block() -> None:
            nonlocal out, at
            out = out or create(uri)
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(packed)
            entries.append((lines[0][0], at, len(packed), len(lines)))
            at += len(packed)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    block()
        if lines:
            block()
        if out:
            packed = zlib.compress(json.dumps(entries).encode())
            out.write(packed)
            out.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([uri] * len(entries)), "first_key": pa.array([e[0] for e in entries]), "offset": pa.array([e[1] for e in entries], pa.int64()),
                "length": pa.array([e[2] for e in entries], pa.int64()), "lines": pa.array([e[3] for e in entries], pa.int64()),
                "directory": pa.array([at] * len(entries), pa.int64()), "directory_length": pa.array([len(packed)] * len(entries), pa.int64())})

    return write


def write_index(captures: DataFrame) -> DataFrame:
    """The sparse directory: one row for each compressed block of sorted index lines.

    Lines of one key may fill several blocks and parts, so a busy host is no limit.
    """
    folder = new_path(captures.sparkSession, "cdx")
    order = ("key", "page_id", "uri", "offset")
    lines = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "part string, first_key string, offset long, length long, lines long, directory long, directory_length long"
    return written(lines.mapInArrow(_index(folder), schema), "directory")


def _lines(file, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(file.read_at(length, offset)).decode().split("\n")]


class _Archives:
    """Open archives of a task, few at a time."""

    def __init__(self):
        self.files: dict = {}

    def record(self, uri: str, offset: int, length: int) -> tuple[dict[str, str], bytes | None]:
        if uri not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[uri] = reader(uri)
        return parse_record(self.files[uri].read_at(length, offset))


def _described(found: list[tuple[dict[str, str], bytes | None]]) -> pa.RecordBatch:
    rows = []
    for head, payload in found:
        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["Payload-Length"])
        if payload is not None and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
            raise ValueError(f"record {head['WARC-Record-ID']} does not hold the payload its header names")
        to = head.get("Refers-To-Page-ID")
        rows.append((int(head["Page-ID"]) if head["Page-ID"] else None, size, digest, head["WARC-Type"], int(to) if to else None, head["WARC-Target-URI"]))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


_DESCRIBED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archives = _Archives()
    for batch in batches:
        for part, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            file = reader(part)
            lines = sorted(_lines(file, offset, length), key=lambda x: x[2:4])
            file.close()
            for start in range(0, len(lines), 100):
                yield _described([archives.record(x[2], x[3], x[4]) for x in lines[start:start + 100]])


def read_archive(directory: DataFrame) -> DataFrame:
    """Every record, read through the index; payloads are held against their digests."""
    blocks = directory.select("part", "offset", "length")
    return blocks.repartition(max(1, blocks.count())).mapInArrow(_read, _DESCRIBED)


def _look_up(parts: list[tuple[str, str, int, int]]) -> Callable:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, directories = _Archives(), {}
        firsts = [p[0] for p in parts]
        for batch in batches:
            for key in batch.column(0).to_pylist():
                found = []
                for first, uri, at, length in parts[max(0, bisect.bisect_left(firsts, key) - 1):]:
                    if first > key:
                        break
                    file = reader(uri)
                    if uri not in directories:
                        directories[uri] = json.loads(zlib.decompress(file.read_at(length, at)))
                    entries = directories[uri]
                    for entry in entries[max(0, bisect.bisect_left([e[0] for e in entries], key) - 1):]:
                        if entry[0] > key:
                            break
                        found += [archives.record(x[2], x[3], x[4]) for x in _lines(file, entry[1], entry[2]) if x[0] == key]
                    file.close()
                if found:
                    yield _described(found)

    return look


def look_up(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """The records of each distinct URL in ``urls`` (column ``url``), by binary search.

    Of the directory only the first key of each part file goes to the tasks; a part holds as
    much as one task has sorted.
    """
    parts = directory.groupBy("part").agg(F.min("first_key").alias("first_key"), F.max("directory").alias("at"), F.max("directory_length").alias("length"))
    known = sorted((r["first_key"], r["part"], r["at"], r["length"]) for r in parts.toLocalIterator())
    keys = urls.select(reversed_host_key(F.col("url").cast("string")).alias("key")).distinct()
    return keys.mapInArrow(_look_up(known), _DESCRIBED)

"""WARC archives: writing, revisit resolution, rewriting without duplicate payloads, and reading back.

Archives are WARC/1.1 files with one gzip member for each record, in a folder that all executors share (any file system that
pyarrow reaches by URI). A writing task names its files by partition and a token of its own; the table of headers, which is
written by the same job, names the files of the attempt that counted, so files of lost or repeated attempts are never read.

Revisit resolution moves headers only: they are shuffled by payload digest, the original of each digest is found by an
aggregation with partial results, and revisits are joined to their originals. Payloads are read once more, archive by archive,
to write the new files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import file_system, forget, keep, new_folder, prepare, width

HEADERS = "row long, file string, offset long, length long, page_id long, uri string, record_type string, digest string, payload_bytes long, record_id string, date string, refers_to long"
RECORDS = "page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, record_id string, refers_to_record string, payload binary"
#: Compressed bytes after which a task starts its next archive.
ARCHIVE_BYTES = 256 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = re.compile(rb"^([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*(.*?)[ \t]*\r?$", re.M)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Writer:
    """Appends records to archives of a folder; ``written`` says where each one went."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = file_system(folder)
        self.uri, self.name, self.number, self.file, self.place = folder, name, 0, None, 0
        self.fs.create_dir(self.folder, recursive=True)

    def add(self, headers: list[tuple[str, str]], block: bytes) -> tuple[str, int, int]:
        if self.file is None or self.place >= ARCHIVE_BYTES:
            self.close()
            self.file, self.place = self.fs.open_output_stream(f"{self.folder}/{self.name}-{self.number:04d}.warc.gz", compression=None), 0
            self.at, self.number = f"{self.uri}/{self.name}-{self.number:04d}.warc.gz", self.number + 1
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = squeeze.compress(b"".join((head.encode(), block, b"\r\n\r\n"))) + squeeze.flush()
        self.file.write(member)
        start, self.place = self.place, self.place + len(member)
        return self.at, start, len(member)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest(), version=4)}>"


def _token(prefix: str = "") -> tuple[int, str]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    return number, f"{prefix}part-{number:05d}-{uuid.uuid4().hex[:12]}"


def write_archives(pages: DataFrame, folder: str, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record for each row; returns the table of their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, name = _token()
        writer, row = Writer(folder, name), number << 40
        for batch in batches:
            out = []
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:x-page:{key}"
                code, identity = digest(payload), _record_id("response", row, key, uri)
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", identity), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{code}"), ("Content-Type", "application/http; msgtype=response")]
                at = writer.add(headers + [("X-Page-ID", str(key))] * (key is not None), _http(len(payload)) + payload)
                out.append((row, *at, key, uri, "response", code, len(payload), identity, date, None))
                row += 1
            yield _rows(out, HEADERS)
        writer.close()

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return keep(rows.mapInArrow(run, HEADERS), "headers")


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``headers`` with record_type and what a revisit refers to: of records with equal payloads of at least ``min_bytes``
    bytes that with the largest page_id (of equal ids the last written) is the response, the others revisit it."""
    dealt = headers.where(F.col("payload_bytes") >= min_bytes)
    groups = dealt.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "row")).alias("last"), F.count(F.lit(1)).alias("size")).where("size > 1")
    originals = headers.join(groups.select(F.col("last.row").alias("row")), "row")
    originals = originals.select("digest", "payload_bytes", F.col("row").alias("o_row"), F.col("page_id").alias("o_page"), F.col("record_id").alias("o_record"), F.col("uri").alias("o_uri"), F.col("date").alias("o_date"))
    joined = headers.drop("record_type", "refers_to").join(originals, ["digest", "payload_bytes"], "left")
    again = F.col("o_row").isNotNull() & (F.col("o_row") != F.col("row"))
    return joined.select(
        "row", "file", "offset", "length", "page_id", "uri", "digest", "payload_bytes", "record_id", F.when(again, "revisit").otherwise("response").alias("record_type"),
        *(F.when(again, F.col(f"o_{c}")).alias(f"o_{c}") for c in ("page", "record", "uri", "date", "row")),
    )


def write_deduplicated(resolved: DataFrame, folder: str, date: str, token: str = "fresh") -> DataFrame:
    """New archives with fresh headers, payloads only in responses; returns the table of their headers."""
    files = resolved.select("file").distinct().count()
    names = ["row", "file", "offset", "length", "page_id", "uri", "digest", "payload_bytes", "record_type", "o_page", "o_uri", "o_date", "o_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, name = _token(f"{token}-")
        writer, source, now = Writer(folder, name), None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != now:
                    system, path = file_system(r["file"])
                    source, now = system.open_input_file(path), r["file"]
                identity = _record_id("fresh", r["row"])
                headers = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", identity), ("WARC-Date", date), ("WARC-Target-URI", r["uri"]), ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("Content-Type", "application/http; msgtype=response")]
                headers += [("X-Page-ID", str(r["page_id"]))] * (r["page_id"] is not None)
                if r["record_type"] == "revisit":
                    headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id("fresh", r["o_row"])), ("WARC-Refers-To-Target-URI", r["o_uri"]), ("WARC-Refers-To-Date", date)]
                    headers += [("X-Refers-To-Page-ID", str(r["o_page"]))] * (r["o_page"] is not None)
                    block = _http(r["payload_bytes"])
                else:
                    _, block = split_record(zlib.decompress(source.read_at(r["length"], r["offset"]), 31))
                at = writer.add(headers, block)
                out.append((r["row"], *at, r["page_id"], r["uri"], r["record_type"], r["digest"], r["payload_bytes"], identity, date, r["o_page"]))
            yield _rows(out, HEADERS)
        writer.close()

    placed = resolved.select(*names).repartition(max(files, width(resolved.sparkSession)), "file").sortWithinPartitions("file", "offset")
    return keep(placed.mapInArrow(run, HEADERS), "fresh-headers")


def split_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.decode() for k, v in _NAME.findall(head)}
    return headers, rest[: int(headers["content-length"])]


def _members(uri: str) -> Iterator[bytes]:
    system, path = file_system(uri)
    with system.open_input_stream(path, compression=None) as source:
        open_, parts = zlib.decompressobj(31), []
        data = source.read(1 << 20)
        while data:
            parts.append(open_.decompress(data))
            data = b""
            if open_.eof:
                yield b"".join(parts)
                data, open_, parts = open_.unused_data, zlib.decompressobj(31), []
            data = data or source.read(1 << 20)
        if parts and any(parts):
            raise ValueError(f"{uri} ends within a record")


def read_archives(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``files`` (file), read member by member; responses' digests and lengths are those of
    the payload that was read, and must agree with the header's. A revisit has those that its header and HTTP block state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                out, size = [], 0
                for raw in _members(uri):
                    headers, block = split_record(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                    if kind == "response":
                        n = len(payload)
                        if digest(payload) != stated:
                            raise ValueError(f"{headers['warc-record-id']}: the payload does not have the stated digest")
                    else:
                        n = int({k.lower(): v for k, v in _NAME.findall(http)}[b"content-length"])
                    ids = [int(headers[x]) if x in headers else None for x in ("x-page-id", "x-refers-to-page-id")]
                    out.append((ids[0], headers["warc-target-uri"], kind, stated, n, ids[1], headers["warc-record-id"], headers.get("warc-refers-to"), payload if with_payload and kind == "response" else None))
                    size += len(payload) if with_payload else 100
                    if size > 4 << 20:
                        yield _rows(out, RECORDS)
                        out, size = [], 0
                yield _rows(out, RECORDS)

    count = files.count()
    return files.select("file").repartition(max(1, count)).mapInArrow(run, RECORDS)


def archive_and_deduplicate(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", fresh_date: str = "2024-01-02T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Archives ``pages`` (page_id, url, html), resolves revisits, writes the deduplicated archives to ``folder`` (a new one
    in the shared folder if not given) and returns their files' names in a table (file).

    A null html is an empty payload; empty payloads are payloads like others, unless ``min_bytes`` is above 0. A null url is
    archived under a URN of the page. A null page_id has no header of its own and is read back as null; it is smaller than any other, and what
    revisits such a record refers to null. Repeated rows are records of their own. An empty table gives no archive. Other columns
    play no part. Archives that failed or repeated attempts left in ``folder`` are deleted at the end, and the first archives with them."""
    spark = prepare(pages.sparkSession)
    source, target = new_folder(spark, "archives"), folder or new_folder(spark, "deduplicated")
    headers = write_archives(pages, source, date)
    token = uuid.uuid4().hex[:8]
    fresh = write_deduplicated(resolve_revisits(headers, min_bytes), target, fresh_date, token)
    files = keep(fresh.select("file").distinct(), "files")
    forget(spark, source)
    _tidy(target, token, {r["file"].rpartition("/")[2] for r in files.toLocalIterator()})
    return files


def _tidy(folder: str, token: str, named: set[str]) -> None:
    """Delete what a call with this token wrote to ``folder`` and no header names. The driver holds one name for each archive."""
    system, path = file_system(folder)
    for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if x.is_file and x.base_name.startswith(f"{token}-part-") and x.base_name not in named:
            system.delete_file(x.path)


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
s AS (SELECT p.page_id, p.h, g.last, sha1(p.h) AS x FROM p JOIN g ON g.h = p.h),
b AS (SELECT *, [CAST(('0x' || substr(x, 10 * i + 1, 10)) AS BIGINT) FOR i IN range(4)] AS five FROM s)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((five[j // 8 + 1] >> (35 - 5 * (j % 8))) & 31 AS INTEGER) + 1, 1) FOR j IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""

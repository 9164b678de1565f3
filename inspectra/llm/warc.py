"""WARC archives: a writer that marks revisits, and a splittable reader of gzip members.

Writer: each task writes one archive of its rows, a gzip member for each record, under a
temporary name and renames it, so a task that runs again leaves the same file. Equal payloads
are found on digests alone; only (digest, page_id) rows are grouped.

Reader: a task gets byte ranges. It scans its range for the gzip magic, takes a candidate only if
its decoded head is a WARC record header, and owns the records that start inside, reading
past the end of the range to finish the last one. From a true member the next follows at its end, up to the range's end
or the file's; a chain that breaks before began inside a payload (a stored archive), and the search goes on behind its first
byte. A chain of inner records that is longer than a whole range is the one case that is not told apart. Records of other
types (warcinfo, request, ...) are passed over; archives of other writers are read too.

Files are reached through the file system of the folder's URI (pyarrow.fs), from executors too.

Defined cases: a null payload is empty; a null page_id or url is written as an empty one and read
back as null; a record id of another writer gives a null page_id, a missing digest is worked out; equal payloads below `least_bytes` are all responses; rows that repeat a page_id
are separate records, and the first response of a payload is that of the smallest page_id (all its
repeats are responses); no pages, no archives.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

MAGIC = b"\x1f\x8b\x08"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head only, whose Content-Length is that of the full payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict | None:
    """The fields of a decoded response or revisit record; null for other types."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields.get("content-length") or len(rest))]
    http, split, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    lengths = [x[15:].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    whole = len(payload) if kind == "response" else int(lengths[0]) if lengths and lengths[0].isdigit() else None

    def number(value: str | None) -> int | None:
        inner = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(inner) if inner != value and inner.lstrip("-").isdigit() else None

    return {
        "page_id": number(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri") or None,
        "record_type": kind,
        "refers_to": number(fields.get("warc-refers-to")),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in fields else digest32(payload) if kind == "response" else None,
        "payload_bytes": whole,
        "payload": payload if kind == "response" else None,
    }


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _digest() -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256))


def find_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, d, first): the pages and payload digests whose payload a smaller page_id has too."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.where("page_id is not null").select("page_id", _digest().alias("d"), F.octet_length(html).alias("n")).where(F.col("n") >= least_bytes)
    first = own.groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return own.join(first, "d").where("page_id <> first").select("page_id", "d", "first").distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the folder; (path, size) of each archive. Runs at once."""
    own = pages.select("page_id", "url", "html", _digest().alias("d"))
    marked = own.join(find_revisits(pages, least_bytes), ["page_id", "d"], "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name, temporary = f"{base}/part-{part:06d}.warc.gz", f"{base}/.part-{part:06d}-{uuid.uuid4().hex}"
        size = 0
        with fs.open_output_stream(temporary, compression=None) as out:
            for b in batches:
                for page_id, url, html, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                    size += out.write(m := member(record(page_id, url, html or b"", first))) or len(m)
        if size:
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "size": [size]})
        else:
            fs.delete_file(temporary)

    return cut(marked.mapInArrow(run, "path string, size long"))


class _Window:
    """A file read piece by piece from a position on: data[pos:] is still to be looked at, and data begins at `at` in the file."""

    def __init__(self, file, at: int, piece: int):
        self.file, self.at, self.piece, self.data, self.pos = file, at, piece, b"", 0
        file.seek(at)

    def more(self) -> bool:
        """Twice as much each time for what is longer than a piece, so that a long record is copied a few times only."""
        if self.pos:
            self.at, self.data, self.pos = self.at + self.pos, self.data[self.pos :], 0
        got = self.file.read(max(self.piece, len(self.data)))
        self.data += got
        return bool(got)


def _decode(w: _Window, step: int = 1 << 16) -> tuple[bytes, int] | None:
    """(record, length of its member) if a WARC record's member begins at w.pos."""
    z, out, used = zlib.decompressobj(31), [], 0
    head = b""
    while True:
        part = w.data[w.pos + used : w.pos + used + step]
        if not part:
            if not w.more():
                return None
            continue
        try:
            got = z.decompress(part)
        except zlib.error:
            return None
        out.append(got)
        used += len(part)
        if len(head) < 7:
            head = (head + got)[:7]
            if not b"WARC/1.".startswith(head):
                return None
        if z.eof:
            return (b"".join(out), used - len(z.unused_data)) if len(head) == 7 else None


def scan(file, begin: int, end: int, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records that start in [begin, end)."""
    w = _Window(file, begin, piece)
    chain: list[bytes] = []  # records of a chain that may still break
    first = begin  # where it began
    while True:
        if len(w.data) - w.pos < len(MAGIC) and w.more():
            continue
        place = w.at + w.pos
        left = len(w.data) - w.pos
        got = _decode(w) if w.data.startswith(MAGIC, w.pos) else None
        if place >= end or not left:
            # The chain is a true one if it goes on behind the range, or the file ends with it.
            if not chain or not left or got is not None:
                yield from chain
                return
        elif got is not None:
            if begin == 0 and first == 0:
                yield got[0]  # from the beginning of the file no member is inside another one
            else:
                chain.append(got[0])
            w.pos += got[1]
            continue
        if chain:  # broken: it began inside a payload
            chain, w = [], _Window(file, first + 1, piece)
        elif left:
            w.pos += 1
        # The next candidate.
        while (at := w.data.find(MAGIC, w.pos)) < 0:
            w.pos = max(w.pos, len(w.data) - len(MAGIC) + 1)
            if w.at + w.pos >= end or not w.more():
                return
        w.pos = at
        first = w.at + at
        if first >= end:
            return


def read(archives: DataFrame, folder: str, split_bytes: int = 4 << 20) -> DataFrame:
    """The records of the archives (path, size): RECORD columns. A task for each range of split_bytes; by number, as adaptive execution would merge these few rows into one task."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))
    ranges = archives.where("size > 0").select("path", F.explode(starts).alias("begin"))
    ranges = ranges.repartition(max(1, ranges.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for b in batches:
            for path, begin in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, weight = [], 0
                with fs.open_input_file(path) as file:
                    for data in scan(file, begin, begin + split_bytes):
                        if (fields := parse(data)) is not None:
                            rows.append(fields)
                        weight += len(data)
                        if rows and weight > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows, weight = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return ranges.select("path", "begin").mapInArrow(run, RECORD)


SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = write(table(spark, sf_dir, "pages"), folder)
    return read(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, h, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda j: list_aggregate(list_transform(range(0, 4), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(d, j * 5 + 1, 5))::BIGINT) >> (15 - 5 * i)) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""

"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. A reading task takes a range of a file's bytes. It
looks for gzip magic in it, takes a place for a record only if the bytes there inflate to a
WARC header, and then owns the record: it reads it to its end, past the range if need be.
A record that begins before the range belongs to another task. So any file can be cut at
any bytes, and no index is needed.

Files are reached with pyarrow's file systems by their full addresses (file:, hdfs:, s3:,
gs:). A writing task names its file by its attempt and reports it in a manifest; a lost or
repeated attempt's file is in no manifest and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, record_batch, shared_dir, table, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 0
#: Bytes of a file that one reading task takes.
SPLIT_BYTES = 16 << 20
COMPRESSION = 4

MAGIC = b"\x1f\x8b\x08"
ID = re.compile(r"<urn:x-page:(-?\d+)>")

MANIFEST = "path string, size long, records long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record(page_id: int | None, url: str | None, digest: bytes, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of its response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Record-ID: <urn:x-page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:sha1:{base64.b32encode(digest).decode()}>")
    if url is not None:  # a line break or other control character can't stand in a header
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    squeeze = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def with_responses(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds sha1 (hex) and refers_to: the largest page_id among equal payloads, null where
    the page is that one, has no page_id, or has too small a payload."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    equal = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    # written, so that the join's own shuffle meets a hot digest and can be split
    best = written(equal.filter("n > 1").select("sha1", "best"))
    rows = rows.join(best, "sha1", "left")
    return rows.withColumn("refers_to", F.when(F.col("best") != F.col("page_id"), F.col("best"))).drop("best")


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record for each page and returns the manifest (path, size, records).

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least
    least_bytes bytes, the page with the largest page_id is the response; the others
    revisit it. Repeated rows that share that page_id are each a response, as are pages
    without page_id.
    """
    folder = (folder or shared_dir(pages.sparkSession)) + "/warc"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, size, n, path = None, 0, 0, ""
        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                if out is None:
                    context = TaskContext.get()
                    path = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{path}", compression=None)  # members are gzipped one by one
                size += out.write(gzipped(record(page_id, url, bytes.fromhex(sha1), len(payload), refers_to, payload)))
                n += 1
        if out is not None:
            out.close()
            yield record_batch({"path": [f"{folder}/{path}"], "size": [size], "records": [n]}, MANIFEST)

    rows = with_responses(pages, least_bytes).select("page_id", "url", "payload", "sha1", "refers_to")
    return written(map_batches(rows, run, MANIFEST))


class Range:
    """A file's bytes, read forward in pieces."""

    def __init__(self, file, size: int, piece: int = 1 << 20):
        self.file, self.size, self.piece, self.at, self.held = file, size, piece, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from there; fewer at the end of the file."""
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(max(n, self.piece), max(0, self.size - at)))
        return self.held[at - self.at : at - self.at + n]

    def find(self, at: int, end: int) -> int:
        """The first place of gzip magic from there on that lies before the end, or -1."""
        while at < end:
            chunk = self.get(at, min(self.piece, end - at + len(MAGIC) - 1))
            if (k := chunk.find(MAGIC)) >= 0:
                return at + k if at + k < end else -1
            at += max(1, len(chunk) - len(MAGIC) + 1)
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The inflated record at that place and the place after it; None if what is there
        doesn't inflate to a WARC header, or isn't a whole gzip member."""
        inflate, out, p, headed = zlib.decompressobj(31), [], at, False
        step = 4096
        try:
            while not inflate.eof:
                if not (chunk := self.get(p, step)):
                    return None
                out.append(inflate.decompress(chunk))
                p += len(chunk)
                step = 65536
                if not headed and (start := b"".join(out)[:5]):
                    if start != b"WARC/"[: len(start)]:
                        return None
                    headed = len(start) == 5
        except zlib.error:
            return None
        whole = b"".join(out)
        return (whole, p - len(inflate.unused_data)) if whole[:5] == b"WARC/" and b"\r\n\r\n" in whole else None


def records(source: Range, start: int, end: int) -> Iterator[bytes]:
    """Records that begin from start up to end."""
    at = source.find(start, end)
    while at >= 0:
        if got := source.member(at):
            yield got[0]
            at = source.find(got[1], end)
        else:
            at = source.find(at + 1, end)


def parse(raw: bytes) -> dict:
    """A record's page, type and payload; a record that another writer made lacks a page_id."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    number = lambda k: int(m[1]) if (m := ID.fullmatch(fields.get(k, ""))) else None
    kind = fields.get("warc-type", "")
    return {
        "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind,
        "payload_bytes": int(size[1]) if size else len(payload), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "refers_to": number("warc-refers-to"), "payload": payload if kind != "revisit" else None,
    }


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the files (path, size), whatever the cuts.

    A response whose payload doesn't have its digest and its length raises an error.
    """
    cuts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    # a task each: the rows are tiny, and adaptive execution would merge them into one
    n = files.agg(F.sum(F.ceil(F.greatest("size", F.lit(1)) / split_bytes))).first()[0] or 1
    splits = files.select("path", "size", cuts.alias("start")).repartitionByRange(int(n), "path", "start")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for raw in records(Range(file, row["size"]), row["start"], min(row["size"], row["start"] + split_bytes)):
                        rows.append(got := parse(raw))
                        if (payload := got["payload"]) is not None:
                            if len(payload) != got["payload_bytes"] or base64.b32encode(hashlib.sha1(payload).digest()).decode() != got["payload_digest"]:
                                raise ValueError(f"damaged record of {got['url']} in {row['path']}")
                            held += len(payload)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield record_batch({n: [r[n] for r in rows] for n in names}, RECORDS)
                            rows, held = [], 0
                    if rows:
                        yield record_batch({n: [r[n] for r in rows] for n in names}, RECORDS)

    return map_batches(splits, run, RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty table gives no files and no rows."""
    files = write(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(h, cast(k // 4 * 5 + 1 AS integer), 5) AS integer) >> cast(15 - k % 4 * 5 AS integer)) & 31 AS integer) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN b USING (h)
"""

"""WARC archives: one gzip member per record, written by tasks, read back sequentially.

An archive is a row (path, length, content), the shape in which Spark's binary file source gives a file, so the
reader takes files of others as well. ``write`` packs records in archives of about ``ARCHIVE_BYTES`` and ``stored`` by the
caller makes them a table in the shared folder: executors need no common local disk. A payload that an earlier page
has, byte for byte, becomes a ``revisit`` record that names the page with the full one.

The reader goes through an archive in pieces: it inflates member by member, frames header and block by
``Content-Length``, and checks block and payload digests. A damaged record is a row with ``error`` set; after it the
reader looks for the next member by the gzip magic, so the rest of the archive is still read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_REVISIT, ARCHIVE_BYTES, PIECE = 100, 1 << 22, 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_READ = "archive string, offset bigint, record_id string, record_type string, target_uri string, page_id bigint, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string, error string"


def plan(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to), one for each row: refers_to is the smallest page_id of an equal payload of
    ``least`` bytes or more, null for that page itself and for smaller payloads.

    Rows that share that smallest page_id are all responses, and so are rows without a page_id, which nothing refers to.
    Only digests and ids are grouped; payloads meet what they refer to by page_id, so common payloads load no task.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    ids = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    refers = ids.join(first, "digest").where("first_id < page_id").select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct()
    return rows.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def _sha(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of one record, as one gzip member."""
    block = b"" if refers_to is not None else _HTTP % len(payload) + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{page_id}' if page_id is not None else f'row/{url}/{_sha(payload)}')}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": uri,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": _sha(block),
        "WARC-Payload-Digest": _sha(payload),
        **({} if page_id is None else {"X-Page-Id": str(page_id)}),
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{refers_to}')}>", "X-Refers-To-Page": str(refers_to)}
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def write(planned: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (path, length, content) of the planned records. Names come from the first record, so a task that runs
    again gives the same archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name = [], 0, None

        def out():
            content = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{name}.warc.gz"]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], names=["path", "length", "content"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in (0, 1, 2, 4)), strict=True):
                one = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                name = f"{page_id.as_py()}-{hashlib.sha256(one).hexdigest()[:16]}" if name is None else name
                held.append(one)
                size += len(one)
                if size >= most:
                    yield out()
                    held, size, name = [], 0, None
        if held:
            yield out()

    return planned.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, length bigint, content binary")


def members(content: bytes | memoryview) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, inflated bytes, error) of each gzip member, inflated piece by piece."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, out, begin, error = zlib.decompressobj(31), [], at, None
        try:
            while not z.eof and at < len(view):
                piece = view[at : at + PIECE]
                out.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
            if not z.eof:
                error = "truncated member"
        except zlib.error as x:
            error = f"bad member: {x}"
        if error:
            found = bytes(view[begin + 1 :]).find(b"\x1f\x8b\x08")
            at = len(view) if found < 0 else begin + 1 + found
        yield begin, b"".join(out), error


def parsed(data: bytes) -> dict:
    """The fields of one inflated record; ``error`` names what doesn't hold."""
    row: dict = {"error": None}
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        return {"error": "no record header"}
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            fields[key.strip().lower()] = value.strip()
    row |= {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri")}
    number = lambda key: int(fields[key]) if fields.get(key, "").lstrip("-").isdigit() else None
    row |= {"page_id": number("x-page-id"), "refers_to": number("x-refers-to-page")}
    size = number("content-length")
    if size is None or size > len(rest):
        return row | {"error": "content length"}
    block, tail = rest[:size], rest[size:]
    if tail != b"\r\n\r\n":
        row["error"] = "record end"
    if (want := fields.get("warc-block-digest", "")).startswith("sha256:") and want != _sha(block):
        row["error"] = "block digest"
    digest = fields.get("warc-payload-digest", "")
    row["payload_digest"] = digest.removeprefix("sha256:") or None
    if row["record_type"] == "revisit":
        return row | {"payload": None, "payload_bytes": number("x-payload-length")}
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    if digest.startswith("sha256:") and digest != _sha(payload):
        row["error"] = "payload digest"
    return row | {"payload": payload, "payload_bytes": len(payload)}


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of archives (path, content). ``payloads`` false leaves the payload column null."""
    kinds = {"archive": pa.string(), "offset": pa.int64(), "record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not content.is_valid:
                    continue
                rows, size = [], 0
                for offset, data, error in members(content.as_buffer()):
                    row = parsed(data)
                    row |= {"archive": path, "offset": offset, "error": error or row["error"]}
                    row["payload"] = row.get("payload") if payloads else None
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > 1 << 23 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in rows], kind) for k, kind in kinds.items()})
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in rows], kind) for k, kind in kinds.items()})

    return archives.select("path", "content").mapInArrow(run, _READ)

"""WARC derivatives: metadata and plain-text conversion records made from response records.

Each response gives two records that refer to it by its id (``WARC-Refers-To``) and to each other
(``WARC-Concurrent-To``): a metadata record, whose JSON block preserves the WARC and HTTP headers of the
source, its digests, title and links; and a conversion record with the visible text.  Both carry the source's
target URI and date and digests of their own blocks.  Record ids are name-based UUIDs of the source id and
the record type, so reruns give the same records.

Files are written one per task, each record a gzip member of its own, under a temporary name and then moved into
place.  Malformed records raise ``ValueError`` with the offset.  Null pages are empty payloads, null URLs leave
the target URI out, repeated rows give repeated records.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .html_tree import plain_text, title_and_links

VERSION = b"WARC/1.1"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of name-based UUIDs
FEED = 1 << 14
DATE = "2024-01-01T00:00:00Z"
CHARSET = re.compile(rb"charset=[\"']?([A-Za-z0-9_.:-]+)", re.I)


class Record(NamedTuple):
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, '|'.join(names))}>"


def to_bytes(record: Record) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in record.headers if k.lower() != "content-length")
    return VERSION + b"\r\n" + head.encode() + f"Content-Length: {len(record.block)}\r\n\r\n".encode() + record.block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at ``at`` and the offset after it."""
    end = data.find(b"\r\n\r\n", at)
    lines = data[at:end].split(b"\r\n") if end >= 0 else [b""]
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip().decode("utf-8", "replace"))
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"bad header in the WARC record at {at}")
        headers.append((name.strip().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")))
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    start = end + 4
    if not length.isdigit() or data[start + int(length) : start + int(length) + 4] != b"\r\n\r\n":
        raise ValueError(f"bad length of the WARC record at {at}")
    return Record(headers, data[start : start + int(length)]), start + int(length) + 4


def records_of(data: bytes) -> Iterator[Record]:
    """All records of a plain file, or of one whose records are gzip members."""
    if data[:2] == b"\x1f\x8b":
        view, pos = memoryview(data), 0
        while pos < len(view):
            member, parts = zlib.decompressobj(31), []
            while not member.eof:
                if pos >= len(view):
                    raise ValueError("truncated gzip member")
                fed = view[pos : pos + FEED]  # a little at a time: what follows the member is copied
                parts.append(member.decompress(fed))
                pos += len(fed) - len(member.unused_data)
            plain, at = b"".join(parts), 0
            while at < len(plain):
                record, at = parse_record(plain, at)
                yield record
        return
    at = 0
    while at < len(data):
        record, at = parse_record(data, at)
        yield record


def response_record(key: object, url: str | None, page: str | None, date: str = DATE) -> Record:
    """A response as a crawler would store it."""
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    target = re.sub(r"[\r\n]+", " ", url) if url is not None else None
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(key), target or "", digest(payload))), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", target)] if target is not None else []
    headers += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return Record(headers, block)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def decoded(http: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content encoding; bytes that don't keep to one stay as they are."""
    named = {k.lower(): v.lower() for k, v in http}
    if "chunked" in named.get("transfer-encoding", ""):
        parts, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            size = payload[at:end].split(b";")[0].strip()
            if not size or size.strip(b"0123456789abcdefABCDEF"):
                break
            parts.append(payload[end + 2 : end + 2 + int(size, 16)])
            at = end + 4 + int(size, 16)
            if not int(size, 16):
                payload = b"".join(parts)
                break
    bits = {"gzip": 31, "x-gzip": 31, "deflate": 15}.get(named.get("content-encoding", ""))
    if bits:
        with contextlib.suppress(zlib.error):
            return zlib.decompress(payload, bits)
    return payload


def derive(source: Record) -> list[Record]:
    """The metadata and the conversion record of a response."""
    if source.get("WARC-Type") != "response":
        return []
    own = source.get("WARC-Record-ID") or ""
    status, http, payload = split_http(source.block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    body = decoded(http, payload)
    found = CHARSET.search(kind.encode()) or CHARSET.search(body[:1024])
    try:
        page = body.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    ids = {kind_: record_id(kind_, own) for kind_ in ("metadata", "conversion")}
    payload_digest = source.get("WARC-Payload-Digest") or digest(payload)
    title, links = title_and_links(page)
    facts = {
        "source": {"headers": source.headers, "block-digest": source.get("WARC-Block-Digest") or digest(source.block), "payload-digest": payload_digest},
        "http": {"status": status, "headers": http},
        "html": {
            "title": title,
            "links": links,
        },
    }
    blocks = {
        "metadata": ("application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True).encode()),
        "conversion": ("text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace")),
    }
    out = []
    for kind_, other in (("metadata", "conversion"), ("conversion", "metadata")):
        mime, block = blocks[kind_]
        headers = [("WARC-Type", kind_), ("WARC-Record-ID", ids[kind_]), ("WARC-Refers-To", own), ("WARC-Concurrent-To", ids[other])]
        for name, copied in (("WARC-Date", "WARC-Date"), ("WARC-Target-URI", "WARC-Target-URI"), ("WARC-Refers-To-Target-URI", "WARC-Target-URI"), ("WARC-Refers-To-Date", "WARC-Date")):
            value = source.get(copied)
            headers += [(name, value)] if value is not None else []
        headers += [("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(block)), ("Content-Type", mime)]
        out.append(Record(headers, block))
    return out


def response_column(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records as bytes: key, record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_bytes(response_record(*r)) for r in rows], pa.binary())], names=["key", "record"])

    columns = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h"))
    return columns.mapInArrow(run, "key long, record binary")


def write_derivatives(responses: DataFrame, directory: str) -> list[str]:
    """Write the derivatives of all response records (column ``record``; ``key`` is kept as a header); the files' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, stream = f"derived-{task.partitionId():06d}.warc.gz", None
        fs, base = scratch.filesystem(directory)
        own = f"{base}/.{name}.{task.taskAttemptId()}"
        for batch in batches:
            if stream is None:
                fs.create_dir(base)
                stream = fs.open_output_stream(own, compression=None)
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for record in derive(parse_record(data)[0]) if data else []:
                    if key is not None:
                        record.headers.append(("WARC-X-Source-Key", str(key)))
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    stream.write(member.compress(to_bytes(record)) + member.flush())
        if stream is not None:
            stream.close()
            fs.move(own, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return sorted(r["file"] for r in responses.select("key", "record").mapInArrow(run, "file string").collect())


def read_records(spark: SparkSession, directory: str, files: list[str]) -> DataFrame:
    """One row per record: key, record_type, record_id, refers_to, concurrent_to, target_uri, date, content_type,
    content_length, block_digest, source_payload_digest, block.  Block digests are verified."""
    schema = (
        "key long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string,"
        " content_type string, content_length long, block_digest string, source_payload_digest string, block binary"
    )
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Concurrent-To", "WARC-Target-URI", "WARC-Date", "Content-Type")
    types = [pa.int64(), *[pa.string()] * 7, pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = scratch.filesystem(directory)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{file}", compression=None) as f:
                    data = f.read()
                rows: list[tuple] = []
                for record in records_of(data):
                    key, want = record.get("WARC-X-Source-Key"), record.get("WARC-Block-Digest")
                    if want and want != digest(record.block):
                        raise ValueError(f"{file}: block digest of {record.get('WARC-Record-ID')} differs")
                    rows.append((None if key is None else int(key), *(record.get(n) for n in names), len(record.block), want, record.get("WARC-Source-Payload-Digest"), record.block))
                    if len(rows) == 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in schema.split(",")])

    entries = spark.createDataFrame([(f,) for f in files], "file string")
    return entries.repartition(max(1, len(files))).mapInArrow(run, schema)

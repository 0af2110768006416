"""Media columns: signature sniffing, validation, carving, and storing payloads as 8-bit samples.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a blob.  Each hit
is checked by that format's validator, which walks the structure (chunks, blocks, segments, pages) and
returns the exact length, or rejects the hit.  A valid hit at the start gives the blob's true type and corrects
the declared one; valid hits elsewhere are embedded media, carved as (offset, length, type).

Null and empty blobs have no type.  A blob of unknown content keeps its declared type.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
RATE = 8000
# Magic bytes of the formats.
SIGNATURES = {
    b"RIFF": "riff",
    b"BM": "image/bmp",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"OggS": "audio/ogg",
}


class Found(NamedTuple):
    offset: int
    length: int
    kind: str


def _riff(b: bytes, at: int) -> tuple[int, str] | None:
    if at + 12 > len(b):
        return None
    size = struct.unpack_from("<I", b, at + 4)[0]
    kind = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}.get(b[at + 8 : at + 12])
    end = at + 8 + size
    if not kind or end > len(b):
        return None
    p, seen = at + 12, set()
    while p < end:
        if p + 8 > end:
            return None
        seen.add(b[p : p + 4])
        n = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + n + (n & 1)
    needs = {"audio/wav": {b"fmt ", b"data"}}.get(kind, set())
    return (end - at, kind) if p == end and needs <= seen else None


def _bmp(b: bytes, at: int) -> tuple[int, str] | None:
    if at + 54 > len(b):
        return None
    size, zero, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or planes != 1 or header not in (40, 108, 124) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        return None
    need = start + ((width * bits + 31) // 32 * 4) * abs(height)
    return (size, "image/bmp") if size >= need and start >= 14 + header and at + size <= len(b) else None


def _png(b: bytes, at: int) -> tuple[int, str] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (first and kind != b"IHDR"):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at, "image/png"
    return None


def _gif(b: bytes, at: int) -> tuple[int, str] | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at, "image/gif"
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            own = b[p + 9]
            p = blocks(p + 11 + (3 << ((own & 7) + 1) if own & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> tuple[int, str] | None:
    p, scan = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        mark = b[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        if mark == 0xD9:
            return (p + 2 - at, "image/jpeg") if scan else None
        n = struct.unpack_from(">H", b, p + 2)[0]
        if mark in (0x00, 0x01) or n < 2 or p + 2 + n > len(b):
            return None
        p += 2 + n
        if mark == 0xDA:
            scan = True
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
            if b[p + 1] == 0xD9:
                return p + 2 - at, "image/jpeg"
    return None


@functools.cache
def _ogg_table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        out.append(r)
    return out


def _ogg(b: bytes, at: int) -> tuple[int, str] | None:
    p, last = at, False
    while not last:
        if b[p : p + 4] != b"OggS" or p + 27 > len(b) or b[p + 4]:
            return None
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b):
            return None
        page = bytearray(b[p:end])
        want = struct.unpack_from("<I", page, 22)[0]
        page[22:26] = b"\0\0\0\0"
        crc, table = 0, _ogg_table()
        for x in page:
            crc = ((crc << 8) & 0xFFFFFFFF) ^ table[(crc >> 24) ^ x]
        if crc != want:
            return None
        last, p = bool(b[p + 5] & 4), end
    return p - at, "audio/ogg"


VALIDATORS = {"riff": _riff, "image/bmp": _bmp, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "audio/ogg": _ogg}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def carve(blob: bytes) -> list[Found]:
    """Valid media in ``blob``, in order; what lies inside other media is listed as well."""
    out = []
    for end, (n, kind) in _automaton().iter(blob.decode("latin-1")):
        at = end + 1 - n
        if checked := VALIDATORS[kind](blob, at):
            out.append(Found(at, *checked))
    return out


def sniff(blob: bytes | None, declared: str | None) -> tuple[str | None, list[Found]]:
    """True type (the declared one if the content names none), and the media embedded further in."""
    return typed(carve(blob), declared) if blob else (None, [])


def typed(found: list[Found], declared: str | None) -> tuple[str | None, list[Found]]:
    """The type of what stands at the start, and the rest."""
    own = next((f for f in found if f.offset == 0), None)
    return (own.kind if own else declared), [f for f in found if f is not own]


def wav_of(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as 8-bit mono samples; its length must be even."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def samples_of(media: bytes) -> memoryview:
    """The data chunk of a WAV file."""
    p, end = 12, 8 + struct.unpack_from("<I", media, 4)[0]
    while p < end:
        n = struct.unpack_from("<I", media, p + 4)[0]
        if media[p : p + 4] == b"data":
            return memoryview(media)[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """A media column: doc_id, n_bytes, declared, media (the padded UTF-8 text as WAV samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [x or b"" for x in part.column(1).to_pylist()]
                media = [wav_of(x + bytes(-len(x) % UNIT or UNIT * (not x))) for x in raw]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "n_bytes": pa.array([len(x) for x in raw], pa.int64()),
                        "declared": pa.array([declared] * len(raw)),
                        "media": pa.array(media, pa.binary()),
                    }
                )

    columns = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("binary").alias("t"))
    return columns.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, media_type, n_embedded, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "media_type", "n_embedded", "feature")}
            for blob, declared in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                found = carve(blob)
                kind, embedded = typed(found, declared)
                if kind != "audio/wav":
                    raise ValueError(f"stored media reads back as {kind}")
                own = next(f for f in found if f.offset == 0)
                payload = samples_of(blob[: own.length])
                wave = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
                feature = {
                    "declared": declared,
                    "type": kind,
                    "corrected": kind != declared,
                    "embedded": [list(f) for f in embedded],
                    "peak": int(np.abs(wave).max()),
                    "rms": round(float(np.sqrt(np.mean(wave.astype(np.float64) ** 2))), 6),
                    "crossings": int(np.count_nonzero((wave[1:] >= 0) != (wave[:-1] >= 0))),
                }
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), kind, len(embedded), json.dumps(feature, sort_keys=True))
                for k, v in zip(out, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "media_type", "feature") else pa.int64()) for k, v in out.items())],
                names=["doc_id", "n_bytes", *out],
            )

    return media.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media_type string, n_embedded long, feature string",
    )

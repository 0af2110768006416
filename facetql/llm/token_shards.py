"""Token-id shards with a minimal perfect hash index.

A shard holds the raw ids of a range of document keys, in ascending key order, and an index that finds
a key's ids with a constant number of reads:

    magic | ids | document table | displacements | slots | footer

* document table: key (int64), null flag (uint8), first id (uint64), one entry per document and an end;
* displacements: int64 for each bucket of about four keys.  A key's 64-bit mix selects the bucket; the
  bucket's displacement d selects the slot ``(f + d // n * g + d % n) mod n`` of the key, or, if negative, names
  the slot ``-1 - d`` itself (buckets of one key).  n keys fill exactly n slots;
* slots: fingerprint (uint32) and row of the document table (uint32).

Tasks write under a temporary name and move the file into place, so a task that runs twice leaves one
file.  Rows with null keys come first and are found by scanning only; repeated keys share a slot that
points at the first of their adjacent rows.  Null text counts as empty.

The manifest has the least and the greatest key of each shard, so a key names its shard, and ``ShardFile``
finds the key there by seeks: footer (once a file), displacement, slot, key, ends, ids.  ``read_keys`` gives
the documents of a table of keys that way, ``read_shards`` those of all keys, by the rows the index names.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .encoding import crc32_of_ids, encoder

MAGIC = b"FQIDS001"
FOOTER = struct.Struct("<QQQQQI4x")  # documents, ids, keys, buckets, seed, bytes per id
KEYS_PER_BUCKET = 4
ROUNDS = 2000
IDS_PER_BATCH = 1 << 20
RUN = 512


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    z = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _places(keys: np.ndarray, seed: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, f, g and fingerprint of each key."""
    n = np.uint64(max(len(keys), 1))
    return _places_of(_mix(keys, seed), _mix(keys, seed + 1_000_003), n, buckets)


def _places_of(a: np.ndarray, b: np.ndarray, n: np.uint64, buckets: int):
    bucket = ((a >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    f = (a & np.uint64(0xFFFFFFFF)) % n
    g = np.uint64(1) + (b >> np.uint64(32)) % max(n - np.uint64(1), np.uint64(1))
    return bucket.astype(np.int64), f.astype(np.int64), g.astype(np.int64), (b & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def build_index(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, displacements, slot and fingerprint of each key; keys are distinct."""
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    for seed in range(1000):
        bucket, f, g, mark = _places(keys, seed, buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        fl, gl, ol = f.tolist(), g.tolist(), order.tolist()
        taken, free = bytearray(n), None
        shift, slot = np.zeros(buckets, np.int64), np.zeros(n, np.int64)
        good, left, calls = True, None, 0
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = ol[starts[b] : starts[b + 1]]
            if not own:
                break
            if len(own) == 1:
                if free is None:
                    free = iter(np.flatnonzero(np.frombuffer(taken, np.uint8) == 0).tolist())
                at = next(free)
                shift[b], slot[own[0]] = -1 - at, at
                continue
            pairs = [(fl[k], gl[k]) for k in own]
            d = next((d for d in range(min(8, n)) if _fits(pairs, d, n, taken)), None)
            if d is None:
                view = np.frombuffer(taken, np.uint8)
                if left is None or calls % 64 == 0:
                    left = np.flatnonzero(view == 0)
                calls += 1
                d = _search(np.array(pairs, np.int64), n, view, left)
            if d is None:
                good = False
                break
            shift[b] = d
            for k, (x, y) in zip(own, pairs):
                slot[k] = (x + d // n * y + d) % n
                taken[slot[k]] = 1
        if good:
            return seed, shift, slot, mark
    raise RuntimeError("no perfect hash found")


def _fits(pairs: list[tuple[int, int]], d: int, n: int, taken: bytearray) -> bool:
    at = [(x + d // n * y + d) % n for x, y in pairs]
    return len(set(at)) == len(at) and not any(taken[i] for i in at)


def _search(pairs: np.ndarray, n: int, taken: np.ndarray, free: np.ndarray) -> int | None:
    """A displacement that puts all keys of a bucket into free slots; ``free`` lists slots some of which may be taken by now."""
    for turn in range(ROUNDS):
        at = (pairs[:, 0] + turn * pairs[:, 1]) % n
        if len(np.unique(at)) < len(at):
            continue
        for part in (free[:400], free[400:]):
            moves = (part - at[0]) % n
            good = np.flatnonzero((taken[(at[:, None] + moves) % n] == 0).all(axis=0))
            if len(good):
                return turn * n + int(moves[good[0]])
    return None


class ShardWriter:
    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.keys: list[int | None] = []
        self.ends: list[int] = [0]
        stream.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        self.stream.write(ids)
        self.keys.append(key)
        self.ends.append(self.ends[-1] + len(ids) // self.width)

    def finish(self) -> None:
        null = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], np.int64)
        first = np.flatnonzero(~null.astype(bool) & np.concatenate(([True], (keys[1:] != keys[:-1]) | (null[:-1] == 1)))[: len(keys)])
        seed, shift, slot, mark = build_index(keys[first])
        slots = np.zeros(len(first), [("mark", "<u4"), ("row", "<u4")])
        slots["mark"][slot], slots["row"][slot] = mark, first
        for part in (keys.astype("<i8"), null, np.array(self.ends, "<u8"), shift.astype("<i8"), slots):
            self.stream.write(part.tobytes())
        self.stream.write(FOOTER.pack(len(keys), self.ends[-1], len(first), len(shift), seed, self.width))


def _parts(n_docs: int, n_ids: int, n_keys: int, n_buckets: int, width: int) -> tuple[dict[str, tuple[np.dtype, int, int]], int]:
    """(type, offset, length) of each part of a shard, and where the footer begins."""
    parts, at = {}, len(MAGIC)
    for name, kind, count in (
        ("payload", f"<u{width}", n_ids),
        ("keys", "<i8", n_docs),
        ("null", "u1", n_docs),
        ("ends", "<u8", n_docs + 1),
        ("shift", "<i8", n_buckets),
        ("slots", [("mark", "<u4"), ("row", "<u4")], n_keys),
    ):
        parts[name] = np.dtype(kind), at, count
        at += parts[name][0].itemsize * count
    return parts, at


def _opened(size: int, read_at) -> tuple[int, dict[str, tuple[np.dtype, int, int]]]:
    """Seed and parts of a shard of so many bytes, by its footer; ``read_at`` takes a length and an offset."""
    if size < len(MAGIC) + FOOTER.size or read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("not a token shard")
    n_docs, n_ids, n_keys, n_buckets, seed, width = FOOTER.unpack(read_at(FOOTER.size, size - FOOTER.size))
    parts, end = _parts(n_docs, n_ids, n_keys, n_buckets, width)
    if end != size - FOOTER.size:
        raise ValueError("token shard of wrong length")
    return seed, parts


class Shard:
    """A shard's bytes, opened for a scan and for many keys at once."""

    def __init__(self, data: bytes):
        self.seed, parts = _opened(len(data), lambda n, at: data[at : at + n])
        self.payload, self.keys, self.null, self.ends, self.shift, self.slots = (
            np.frombuffer(data, kind, count, at) for kind, at, count in parts.values()
        )
        self.n_docs, self.n_ids = len(self.keys), len(self.payload)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key, -1 where the shard doesn't hold it."""
        n = len(self.slots)
        if not n or not len(keys):
            return np.full(len(keys), -1, np.int64)
        keys = np.asarray(keys, np.int64)
        bucket, f, g, mark = _places_of(
            _mix(keys, self.seed), _mix(keys, self.seed + 1_000_003), np.uint64(n), len(self.shift)
        )
        d = self.shift[bucket]
        slot = np.where(d < 0, -1 - d, (f + d // n * g + d) % n)
        row = self.slots["row"][slot].astype(np.int64)
        return np.where((self.slots["mark"][slot] == mark) & (self.keys[row] == keys), row, -1)

    def places(self) -> np.ndarray:
        """The row of each document: of keys that one row has, where the index finds it; null and repeated keys are scanned."""
        place, keyed = np.arange(self.n_docs), self.null == 0
        rows = self.rows(self.keys)
        if (rows[keyed] < 0).any():
            raise ValueError("a key isn't found through the index")
        single = keyed & (np.bincount(rows[keyed], minlength=self.n_docs)[rows] == 1)
        place[single] = rows[single]
        return place

    def ids(self, row: int) -> np.ndarray:
        return self.payload[int(self.ends[row]) : int(self.ends[row + 1])]


class ShardFile:
    """A shard opened for keyed access: a key takes the same few small reads however large the shard is."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        self.seed, self.parts = _opened(file.size(), file.read_at)

    def _read(self, part: str, first: int, count: int = 1) -> np.ndarray:
        kind, at, _ = self.parts[part]
        return np.frombuffer(self.file.read_at(kind.itemsize * count, at + kind.itemsize * first), kind, count)

    def row(self, key: int) -> int:
        """First row of the key, -1 if the shard doesn't hold it."""
        n, buckets = self.parts["slots"][2], self.parts["shift"][2]
        if not n:
            return -1
        keys = np.array([key], np.int64)
        bucket, f, g, mark = (int(x[0]) for x in _places_of(_mix(keys, self.seed), _mix(keys, self.seed + 1_000_003), np.uint64(n), buckets))
        d = int(self._read("shift", bucket)[0])
        slot = self._read("slots", -1 - d if d < 0 else (f + d // n * g + d % n) % n)[0]
        row = int(slot["row"])
        return row if int(slot["mark"]) == mark and int(self._read("keys", row)[0]) == key else -1

    def get(self, key: int) -> list[tuple[int, np.ndarray]]:
        """(first id, ids) of each document of the key; further rows of a repeated key stand next to the first."""
        row, out = self.row(key), []
        while 0 <= row < self.parts["keys"][2]:
            run = self._read("keys", row, min(RUN if out else 2, self.parts["keys"][2] - row))
            other = np.flatnonzero(run != key)
            count = int(other[0]) if len(other) else len(run)
            ends = self._read("ends", row, count + 1).tolist()
            out += [(a, self._read("payload", a, b - a)) for a, b in zip(ends, ends[1:])]
            row = row + count if count == len(run) else -1
        return out


def write_shards(docs: DataFrame, directory: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the shards below ``directory`` (shared by all executors); the manifest, in key order.

    The manifest has a row for each shard, so its length is the number of shuffle partitions at most.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer = encoder(tokenizer), None
        end = int(end_id).to_bytes(enc.dtype.itemsize, "little")
        task = TaskContext.get()
        name = f"ids-{task.partitionId():06d}.shard"
        fs, base = scratch.filesystem(directory)
        own = f"{base}/.{name}.{task.taskAttemptId()}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(base)
                writer = ShardWriter(fs.open_output_stream(own), enc.dtype.itemsize)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer.add(key, enc.encode(text) + end)
        if writer is not None:
            writer.finish()
            writer.stream.close()
            fs.move(own, f"{base}/{name}")
            held = [k for k in (next((k for k in writer.keys if k is not None), None), writer.keys[-1]) if k is not None]
            about = {"shard": task.partitionId(), "file": name, "n_docs": len(writer.keys), "n_ids": writer.ends[-1]}
            about |= {"first_key": held[0] if held else None, "last_key": held[-1] if held else None}
            yield pa.RecordBatch.from_pylist([about], pa.schema([(c, pa.string() if c == "file" else pa.int64()) for c in about]))

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
        .repartitionByRange(F.col("k").asc_nulls_first())
        .sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    )
    written = ordered.mapInArrow(write, "shard long, file string, n_docs long, n_ids long, first_key long, last_key long").collect()
    manifest, start = [], 0
    for row in sorted(written, key=lambda r: r["shard"]):
        manifest.append(row.asDict() | {"start": start, "directory": directory})
        start += row["n_ids"]
    fs, base = scratch.filesystem(directory)
    fs.create_dir(base)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"end_id": end_id, "shards": manifest}).encode())
    return manifest


def read_shards(spark: SparkSession, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32[, ids]."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                fs, base = scratch.filesystem(entry["directory"])
                with fs.open_input_stream(f"{base}/{entry['file']}") as f:
                    shard = Shard(f.read())
                place, ends = shard.places(), shard.ends.astype(np.int64)
                out = {
                    "doc_id": pa.array(shard.keys, mask=shard.null.astype(bool)),
                    "start": pa.array(ends[place] + entry["start"]),
                    "n_tokens": pa.array(np.diff(ends)[place]),
                    "ids_crc32": pa.array([crc32_of_ids(shard.ids(i)) for i in place], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([shard.ids(i).astype(np.int32) for i in place], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    entries = spark.createDataFrame(
        [(m["directory"], m["file"], m["start"]) for m in manifest], "directory string, file string, start long"
    )
    return entries.repartition(max(1, len(manifest))).mapInArrow(read, schema)


def read_keys(manifest: list[dict], keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """The documents of a table of keys, read by seeks: doc_id, start, n_tokens, ids_crc32, ids.

    One row per row of ``keys`` and document of that key, as many as the shards hold; a null key and a key that
    no shard holds give none.  A task opens a shard once a batch and never loads it whole.
    """
    held = sorted((m for m in manifest if m["first_key"] is not None), key=lambda m: m["first_key"])
    last = [m["last_key"] for m in held]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    types = pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.list_(pa.int32())])))

    def found(wanted: list[int]) -> Iterator[dict]:
        shard = opened = None
        try:
            for key in sorted(wanted):
                at = bisect_left(last, key)
                if at == len(held) or key < held[at]["first_key"]:
                    continue
                if at != shard:
                    if opened:
                        opened.file.close()
                    fs, base = scratch.filesystem(held[at]["directory"])
                    shard, opened = at, ShardFile(fs.open_input_file(f"{base}/{held[at]['file']}"))
                for first, ids in opened.get(key):
                    values = key, held[at]["start"] + first, len(ids), crc32_of_ids(ids), ids.astype(np.int32)
                    yield dict(zip(names, values))
        finally:
            if opened:
                opened.file.close()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, total = [], 0
            for row in found([k for k in batch.column(0).to_pylist() if k is not None]):
                rows.append(row)
                total += row["n_tokens"]
                if total >= IDS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, types)
                    rows, total = [], 0
            yield pa.RecordBatch.from_pylist(rows, types)

    return keys.select(F.col(key_col).cast("long")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")

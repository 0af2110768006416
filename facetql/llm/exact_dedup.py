"""Exact dedup by an extendible-hash index kept on shared files (DataFrame functions only).

1. Every row becomes an index entry ``(key, uid, doc_id, body)`` in the shared folder: ``key`` is a
   64-bit hash of the normalised text (A-Z lower-cased, nothing else), ``uid`` numbers the rows.
2. The directory starts with one bucket and doubles: a bucket that holds more than ``bucket_bytes``
   splits by its next hash bit, up to ``depth_limit`` bits.  It is derived from a histogram of at most
   ``2 ** depth_limit`` cells, so neither histogram nor directory grows past 65,536 rows at the
   default; a bucket that stays overfull at that depth simply chains more pages.
3. A hash shuffle groups the entries by (bucket, key, body), which compares bodies byte for byte; no task owns a bucket.
   Copies within a map task collapse before the shuffle, so a hot group costs one row per map task.
   Different bodies under one key form a chain and stay separate groups.
4. Each entry looks its group up: by key alone where the chain has one body, by key and body elsewhere.
   Groups above a thousandth of all rows (at most 1000 of them) are broadcast, the others joined by key.

Null text counts as empty.  Repeated rows, even with equal ids, yield one survivor.  Null ids sort below
all others.  An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEAVY_SHARE = 1000
#: Of a group: the id that stays, the one row of that id that stays, the number of rows.
GROUP = {
    "keep_id": "max(doc_id)",
    "keep_uid": "coalesce(max_by(uid, doc_id), max(uid))",
    "group_size": "count(1)",
}


def _grouped() -> list[Column]:
    return [F.expr(x).alias(name) for name, x in GROUP.items()]




def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def grow_directory(cells: list[tuple[int, int]], depth_limit: int, bucket_bytes: int) -> list[tuple[int, int, int]]:
    """(prefix, bucket, local depth) for each histogram cell (prefix of ``depth_limit`` bits, bytes)."""
    out: list[tuple[int, int, int]] = []
    buckets, todo = 0, [(0, sorted(cells))]
    while todo:
        depth, own = todo.pop()
        if depth < depth_limit and len(own) > 1 and sum(b for _, b in own) > bucket_bytes:
            bit = depth_limit - depth - 1
            halves = [[c for c in own if (c[0] >> bit) & 1 == side] for side in (1, 0)]
            todo += [(depth + 1, half) for half in halves if half]
            continue
        out += [(prefix, buckets, depth) for prefix, _ in own]
        buckets += 1
    return out


class HashIndex:
    """The index files and the groups that the owner tasks found in them."""

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth_limit: int = 16, bucket_bytes: int = 128 << 20
    ):
        spark = docs.sparkSession
        self.row_columns = docs.columns
        body = normalized(F.col(text_col))
        self.index = scratch.materialize(
            docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("body"))
            .select("row", F.xxhash64("body").alias("key"), F.octet_length("body").cast("long").alias("n_bytes"))
            .withColumn("uid", F.monotonically_increasing_id()),
            "hash-index",
        )
        self.entries = self.index.select(
            F.col(f"row.`{id_col}`").alias("doc_id"), "uid", "key", normalized(F.col(f"row.`{text_col}`")).alias("body")
        )
        prefix = F.shiftrightunsigned("key", 64 - depth_limit).cast("int")
        cells = (
            self.index.groupBy(prefix.alias("prefix")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        )
        self.total = sum(c["n"] for c in cells)
        leaves = grow_directory([(c["prefix"], c["b"]) for c in cells], depth_limit, bucket_bytes)
        columns = list(zip(*leaves)) or [[], [], []]
        table = pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("prefix", "bucket", "depth"), columns)})
        self.directory = scratch.materialize(spark.createDataFrame(table), "hash-directory")
        self.owned = scratch.materialize(
            self.entries.withColumn("prefix", prefix)
            .join(F.broadcast(self.directory), "prefix")
            .groupBy("bucket", "key", "body")
            .agg(*_grouped())
            .withColumn("text_sha256", F.sha2("body", 256))
            .drop("body"),
            "hash-owners",
        )

    def groups(self) -> DataFrame:
        """One row per entry: uid, doc_id, keep_id, keep_uid, group_size, text_sha256, bucket, kept."""
        rows = self.entries.select("doc_id", "uid", "key")
        chained = self.owned.groupBy("key").agg(F.count(F.lit(1)).alias("chain")).filter("chain > 1").select("key")
        if chained.isEmpty():
            found = _lookup(rows, self.owned, self.total)
        else:
            chained = scratch.materialize(chained, "hash-chains")
            found = _lookup(
                rows.join(chained, "key", "left_anti"), self.owned.join(chained, "key", "left_anti"), self.total
            ).unionByName(_chain_lookup(self.entries, chained, self.owned))
        return found.withColumn("kept", F.col("uid") == F.col("keep_uid"))

    def survivors(self) -> DataFrame:
        """The kept rows with the columns they came with."""
        copies = scratch.materialize(self.groups().filter(~F.col("kept")).select("uid"), "hash-copies")
        return self.index.join(scratch.sized(copies), "uid", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in self.row_columns])


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Of equal texts the row with the largest id stays.
    """
    return HashIndex(docs, **options).groups().select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its own columns and one row of each group of equal texts."""
    return HashIndex(docs, **options).survivors()


def _lookup(rows: DataFrame, owned: DataFrame, total: int) -> DataFrame:
    """Join on key: at most HEAVY_SHARE groups can each hold over total/HEAVY_SHARE rows, so those fit a broadcast."""
    limit = max(total // HEAVY_SHARE, 1)
    heavy, light = owned.filter(F.col("group_size") > limit), owned.filter(F.col("group_size") <= limit)
    by_broadcast = rows.join(F.broadcast(heavy), "key")
    by_shuffle = rows.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key")
    return by_broadcast.unionByName(by_shuffle)


def _chain_lookup(entries: DataFrame, chained: DataFrame, owned: DataFrame) -> DataFrame:
    """Entries whose key carries several bodies: compare the bodies themselves."""
    entries = entries.join(chained, "key")
    heads = entries.groupBy("key", "body").agg(*_grouped())
    buckets = owned.join(chained, "key", "left_semi").groupBy("key").agg(F.min("bucket").alias("bucket"))
    return (
        entries.select("doc_id", "uid", "key", "body")
        .join(heads, ["key", "body"])
        .withColumn("text_sha256", F.sha2("body", 256))
        .join(buckets, "key")
        .select("key", "doc_id", "uid", "bucket", "keep_id", "keep_uid", "group_size", "text_sha256")
    )

"""N-gram Jaccard join: links and components of documents whose shingle sets are alike.

The join is a sparse product of the document by n-gram incidence matrix with its transpose, restricted to
blocks that can hold links and bounded by sizes:

1. Equal sets collapse into classes; only the least id of a class goes on.
2. Columns.  A set of s n-grams shares at least a = ceil(num s / den) with any partner.  Of each set the s - a + c
   n-grams of the least hash are kept, c = ``EXTRA`` s: two partners have c of these in common, c that of the smaller.  A
   column count (pre-aggregated in the map tasks) tells which are held twice; sets with fewer such columns than the c
   of their smallest partner are out.  What is left of a passage that many documents share seldom suffices for that.
3. Blocks.  A set with t shared columns of which c are due has one in common with each partner among its t - c + 1
   rarest.  Sets are tied to the least set that has such a column; what hangs together is a block.
4. Product.  The n-gram sets of a block meet in one task, which accumulates overlap counts column by
   column for one row of the matrix at a time, drops every pair below the bound that the sizes give, and links
   the rest.  Rows are visited breadth first and only unlinked columns stay in the product, so a block of near
   copies costs about one row, not all pairs.  Blocks over ``block_ngrams`` (and over a ``SPREAD``-th of all n-grams in
   blocks, if that is more than ``LEAST_NGRAMS``) are cut into pieces that share ``PIVOTS`` rows; rows that are not in the
   block's main component afterwards are multiplied with all pieces.
5. Components of the links, then of the documents through their classes.
6. Counting links takes the whole product instead of step 4's part: all rows against all columns.  N-grams that most
   rows of a block have are counted by the rows that lack them, so near copies stay cheap.  The pieces of a large
   block are written once, as files in the shared folder, and each two meet in a task that reads their files, so that
   each pair is counted once and no set is shuffled for each task it takes part in.

Null and empty texts have an empty set and link with nothing.  Texts of fewer than n words have one n-gram, the
whole sequence.  Ids are taken to be unique; of rows that share an id each is classed by its own text.  A row
without id belongs to the component of its equals, if there are any, else to none (null).  N-grams are compared
by 64-bit hashes.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components
from .words import U, mix, shingle_sets

PIVOTS = 16
BLOCK_NGRAMS = 1_000_000
SPREAD = 64
LEAST_NGRAMS = 20_000
EXTRA = 0.2
SALT = U(0x94D049BB133111EB)
HEAVY_SHARE = 1000


def least_overlap(size: int, num: int, den: int) -> int:
    """N-grams that a set of this size shares at least with a partner, and the size of its smallest partner."""
    return -(-num * size // den)


def due(size: int) -> int:
    """Kept columns that two partners have in common if the smaller has this size."""
    return max(1, size * int(100 * EXTRA) // 100)


def set_marks(ngrams: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    first = mix(ngrams ^ SALT).sum(dtype=U)
    second = mix(ngrams * U(0xE7037ED1A0B428DB) + U(len(ngrams))).sum(dtype=U)
    return int(np.int64(first.astype(np.int64))), int(np.int64(second.astype(np.int64)))


def numbers(column: str) -> Column:
    """One row for each of 0, 1, .. below the column's value."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(column).cast("long") - 1))


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]


def _slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, mark1, mark2) for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *set_marks(s)) for part in _slices(batch) for s in shingle_sets(_texts(part, 1), n)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_shingles", "mark1", "mark2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, mark1 long, mark2 long")


def column_table(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(key, doc_id): the n-grams of least hash of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                keys, counts = [], []
                for s in shingle_sets(_texts(part, 1), n):
                    size = len(s)
                    kept = min(size, size - least_overlap(size, num, den) + due(size)) if size else 0
                    # The shingles' hashes are sorted already.
                    keys.append(s[:kept])
                    counts.append(kept)
                owners = np.repeat(np.arange(part.num_rows), counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.empty(0, U), *keys]).view(np.int64)), part.column(0).take(pa.array(owners))], names=["key", "doc_id"]
                )

    return docs.mapInArrow(run, "key long, doc_id long")


def product_links(ids: list[int], sets: list[np.ndarray], num: int, den: int, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of a block that span its components.

    One row of the product at a time: overlap counts of a document with all documents not yet reached.
    ``joined`` names components known already; no links are sought within them.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    label = np.arange(n) if joined is None else np.unique(np.array(joined), return_inverse=True)[1]
    members: dict[int, list[int]] = {}
    for i, x in enumerate(label.tolist()):
        members.setdefault(x, []).append(i)
    flat = np.concatenate(sets) if n else np.empty(0, U)
    columns = np.unique(flat, return_inverse=True)[1]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    row_of = np.repeat(np.arange(n), sizes)
    alive = np.ones(n, bool)
    links: list[tuple[int, int]] = []

    def incidence() -> tuple[np.ndarray, np.ndarray]:
        """Rows by column, of what is alive."""
        use = alive[row_of]
        cols, rows = columns[use], row_of[use]
        order = np.argsort(cols, kind="stable")
        return rows[order], np.concatenate(([0], np.cumsum(np.bincount(cols, minlength=width))))

    width = int(columns.max()) + 1 if len(columns) else 0
    rows, at = incidence()
    built = n
    for start in range(n):
        if not alive[start]:
            continue
        queue = list(members[int(label[start])])
        alive[queue] = False
        while queue:
            left = int(np.count_nonzero(alive))
            if not left:
                break
            if left * 2 < built:
                rows, at = incidence()
                built = left
            i = queue.pop()
            own = columns[ends[i] : ends[i + 1]]
            lo, count = at[own], at[own + 1] - at[own]
            total = int(count.sum())
            if not total:
                continue
            where = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)
            overlap = np.bincount(rows[where], minlength=n)
            near = np.flatnonzero(alive & (overlap * (den + num) >= num * (sizes[i] + sizes)) & (overlap > 0))
            for j in near.tolist():
                if alive[j]:
                    links.append((ids[i], ids[j]))
                    more = members[int(label[j])]
                    alive[more] = False
                    queue += more
    return links


def product_counts(ids: list[int], sets: list[np.ndarray], num: int, den: int, sides: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(links that span the components, (id, number of links)) of the whole product of different sets.

    Two rows of the same side other than -1 are left to another task.
    """
    first = list({set_marks(s): i for i, s in reversed(list(enumerate(sets)))}.values())
    ids, sets, side = [ids[i] for i in first], [sets[i] for i in first], np.array([sides[i] for i in first], np.int64)
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    row_of = np.repeat(np.arange(n), sizes)
    held = np.bincount(columns)
    dense = held * 2 > n
    # Rows by column: those that have it, of a dense column those that lack it.
    sparse = ~dense[columns]
    rows = [row_of[sparse][np.argsort(columns[sparse], kind="stable")]]
    lacks = np.ones((int(dense.sum()), n), bool)
    lacks[(np.cumsum(dense) - 1)[columns[~sparse]], row_of[~sparse]] = False
    rows = np.concatenate([*rows, np.nonzero(lacks)[1]])
    count = np.where(dense, n - held, held)
    at = np.where(dense, int(held[~dense].sum()) + np.cumsum(count * dense) - count, np.cumsum(count * ~dense) - count)

    def tally(own: np.ndarray) -> np.ndarray:
        many = count[own]
        where = np.repeat(at[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.bincount(rows[where], minlength=n)

    links, counts = [], []
    label = np.arange(n)
    for i in range(n):
        own = columns[ends[i] : ends[i + 1]]
        common = dense[own]
        overlap = tally(own[~common]) + int(common.sum()) - tally(own[common])
        near = (overlap * (den + num) >= num * (sizes[i] + sizes)) & (overlap > 0) & ((side != side[i]) | (side == -1))
        near[i] = False
        near = np.flatnonzero(near)
        if not len(near):
            continue
        counts.append((ids[i], len(near)))
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i]:
                links.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return links, counts


def block_links(rows: DataFrame, n: int, num: int, den: int, counted: bool = False) -> DataFrame:
    """Links (a, b) within each task of (task, doc_id, text, known); ``known`` is the component found before.

    ``counted``: also rows (a, null, n) with the number of a's links in the task; ``known`` is the row's side then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, sets, known = None, [], [], []
        out: list[tuple[int, int | None, int | None]] = []
        for batch in batches:
            for part in _slices(batch, 500):
                tasks = part.column(0).to_pylist()
                own = zip(tasks, part.column(1).to_pylist(), part.column(3).to_pylist(), shingle_sets(_texts(part, 2), n))
                for t, doc, before, s in own:
                    if t != task:
                        out += found(ids, sets, known)
                        task, ids, sets, known = t, [], [], []
                    ids.append(doc)
                    sets.append(s)
                    known.append(before)
            if len(out) > 10_000:
                yield links_batch(out)
                out = []
        out += found(ids, sets, known)
        if out:
            yield links_batch(out)

    def found(ids: list[int], sets: list[np.ndarray], known: list[int]) -> list[tuple[int, int | None, int | None]]:
        if len(ids) < 2:
            return []
        if not counted:
            return [(a, b, None) for a, b in product_links(ids, sets, num, den, known)]
        links, counts = product_counts(ids, sets, num, den, known)
        return [(a, b, None) for a, b in links] + [(a, None, c) for a, c in counts]

    def links_batch(links: list[tuple[int, int | None, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b", "n"])

    ordered = rows.select("task", "doc_id", "text", "known").repartition("task").sortWithinPartitions("task", "doc_id")
    return ordered.mapInArrow(run, "a long, b long, n long")


def piece_files(rows: DataFrame, n: int, directory: str) -> DataFrame:
    """(block, piece, path): the sets of each piece of (block, piece, doc_id, text), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []
        for batch in batches:
            for part in _slices(batch, 500):
                places = zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                for place, doc, s in zip(places, part.column(2).to_pylist(), shingle_sets(_texts(part, 3), n)):
                    if place != at:
                        yield from written(at, ids, sets)
                        at, ids, sets = place, [], []
                    ids.append(doc)
                    sets.append(s)
        yield from written(at, ids, sets)

    def written(at: tuple[int, int] | None, ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if at is None:
            return
        path = f"{directory}/{uuid.uuid4().hex}.npz"
        packed = io.BytesIO()
        np.savez(packed, ids=np.array(ids, np.int64), sizes=np.array([len(s) for s in sets]), flat=np.concatenate(sets))
        fs, inner = scratch.filesystem(path)
        fs.create_dir(scratch.filesystem(directory)[1], recursive=True)
        with fs.open_output_stream(inner) as f:
            f.write(packed.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([path])], names=["block", "piece", "path"])

    dealt = rows.select("block", "piece", "doc_id", "text").repartition("block", "piece").sortWithinPartitions("block", "piece", "doc_id")
    return dealt.mapInArrow(run, "block long, piece int, path string")


def pair_links(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Links and their numbers, as ``block_links`` gives them, between two files of sets or (no second) within one."""

    def read(path: str) -> tuple[list[int], list[np.ndarray]]:
        fs, inner = scratch.filesystem(path)
        with fs.open_input_stream(inner) as f:
            held = np.load(io.BytesIO(f.read()))
        return held["ids"].tolist(), np.split(held["flat"], np.cumsum(held["sizes"])[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, second in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, sets = read(first)
                sides = [-1] * len(ids)
                if second is not None:
                    more, others = read(second)
                    sides = [0] * len(ids) + [1] * len(more)
                    ids, sets = ids + more, sets + others
                links, counts = product_counts(ids, sets, num, den, sides)
                out = [(a, b, None) for a, b in links] + [(a, None, c) for a, c in counts]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "n"])

    return pairs.mapInArrow(run, "a long, b long, n long")


class NgramJoin:
    """Links of documents with den * intersection >= num * union of their n-word shingle sets."""

    def __init__(self, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_ngrams: int = BLOCK_NGRAMS, counted: bool = True):
        self.n, self.num, self.den, self.block_ngrams, self.counted = n, num, den, block_ngrams, counted
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
        self.sets = scratch.materialize(set_table(self.texts, n), "ngram-sets")
        self.classes = self._classes()
        if counted:
            product = self._whole_product()
            self.links = product.filter("b is not null").select("a", "b")
            self.degrees = product.filter("b is null").groupBy(F.col("a").alias("x")).agg(F.sum("n").alias("n_links"))
        else:
            self.links = self._links()

    def _classes(self) -> DataFrame:
        """(doc_id, n_shingles, rep): rep is the least id with the same set."""
        marks = ["mark1", "mark2"]
        groups = scratch.materialize(
            self.sets.filter("n_shingles > 0").groupBy(*marks).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("held")), "ngram-classes"
        )
        total = groups.agg(F.sum("held").alias("t")).collect()[0]["t"] or 0
        limit = max(total // HEAVY_SHARE, 1)  # at most HEAVY_SHARE groups hold more rows than this
        self.heavy = groups.filter(F.col("held") > limit).select("rep")
        heavy = F.broadcast(groups.filter(F.col("held") > limit).drop("held"))
        light = groups.filter(F.col("held") <= limit).drop("held")
        rows = self.sets.filter("n_shingles > 0")
        found = rows.join(heavy, marks).unionByName(rows.join(heavy, marks, "left_anti").join(light, marks))
        return scratch.materialize(found.select("doc_id", "n_shingles", "rep"), "ngram-members")

    def _blocks(self) -> DataFrame:
        """(doc_id, block, weight) of class representatives that share a block with others."""
        sizes = self.classes.filter("doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("weight"))
        sizes = scratch.materialize(sizes, "ngram-sizes")
        chosen = self.texts.join(scratch.sized(sizes.select("doc_id")), "doc_id", "left_semi")
        columns = column_table(chosen, self.n, self.num, self.den)
        held = columns.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
        shared = columns.join(held.hint("shuffle_hash"), "key")
        # The c of the smallest partner.
        least = F.expr(f"greatest(1L, (weight * {self.num} + {self.den - 1}) div {self.den} * {int(100 * EXTRA)} div 100)")
        rank = Window.partitionBy("doc_id").orderBy("held", "key")
        every = Window.partitionBy("doc_id")
        ranked = (
            shared.join(sizes, "doc_id")
            .withColumn("rank", F.row_number().over(rank))
            .withColumn("spare", F.count(F.lit(1)).over(every) - least)
            .filter(F.col("rank") <= F.col("spare") + 1)
        )
        ranked = scratch.materialize(ranked.select("key", "doc_id"), "ngram-columns")
        heads = ranked.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).filter("head <> last").drop("last")
        # Dealt anew, so that a hot key's rows can be split in the join.
        ties = ranked.join(heads.hint("rebalance"), "key").filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
        blocks = connected_components(ties)
        return scratch.materialize(
            blocks.join(sizes, blocks["node"] == sizes["doc_id"]).select(F.col("node").alias("doc_id"), F.col("component").alias("block"), "weight"),
            "ngram-blocks",
        )

    def _limit(self, blocks: DataFrame) -> int:
        """N-grams that may meet in one task."""
        total = blocks.agg(F.sum("weight").alias("t")).collect()[0]["t"] or 0
        return min(self.block_ngrams, max(LEAST_NGRAMS, total // SPREAD))

    def _whole_product(self) -> DataFrame:
        """(a, b, null): links that span the components; (a, null, n): parts of the number of a's links."""
        blocks = self._blocks()
        limit = self._limit(blocks)
        weights = blocks.groupBy("block").agg(F.sum("weight").alias("total"))
        # Two pieces meet in a task.
        pieces = F.when(F.col("total") > limit, F.ceil(2 * F.col("total") / limit)).otherwise(1).cast("int")
        large = scratch.materialize(weights.withColumn("pieces", pieces).filter("pieces > 1"), "ngram-large")
        tasks = blocks.join(large.select("block"), "block", "left_anti").select(F.xxhash64("block").alias("task"), "doc_id", F.lit(-1).cast("long").alias("known"))
        found = self._tasks(tasks, True)
        if not large.isEmpty():
            own = blocks.join(large, "block").select("block", F.pmod(F.xxhash64("doc_id"), "pieces").cast("int").alias("piece"), "doc_id")
            wanted = self.texts.join(scratch.sized(scratch.materialize(own, "ngram-pieces")), "doc_id")
            files = scratch.materialize(piece_files(wanted, self.n, scratch.new_path(blocks.sparkSession, "ngram-files")), "ngram-manifest")
            one, other = files.toDF("block", "i", "first"), files.toDF("block", "j", "second")
            pairs = one.join(other, "block").filter("i <= j").select("first", F.when(F.col("i") < F.col("j"), F.col("second")).alias("second"))
            pairs = scratch.materialize(pairs, "ngram-pairs")
            # The rows are names of files: by their size alone they would all go to one task.
            dealt = pairs.repartition(max(1, pairs.count() // 4))
            found = found.unionByName(pair_links(dealt, self.num, self.den))
        return scratch.materialize(found, "ngram-product")

    def _links(self) -> DataFrame:
        blocks = self._blocks()
        limit = self._limit(blocks)
        weights = blocks.groupBy("block").agg(F.sum("weight").alias("total"))
        weights = weights.withColumn("pieces", F.ceil(F.col("total") / limit).cast("int"))
        large = scratch.materialize(weights.filter("pieces > 1"), "ngram-large")
        small = blocks.join(large.select("block"), "block", "left_anti").select(
            F.xxhash64("block").alias("task"), "doc_id", F.col("doc_id").alias("known")
        )
        if large.isEmpty():
            return scratch.materialize(self._product(small), "ngram-links")
        rank = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("doc_id"), "doc_id"))
        own = scratch.materialize(blocks.join(large, "block"), "ngram-pieces")
        pivots = own.withColumn("r", rank).filter(F.col("r") <= PIVOTS)
        spread = own.select("block", "doc_id", F.pmod(F.xxhash64("doc_id"), "pieces").alias("piece")).unionByName(
            pivots.select("block", "doc_id", numbers("pieces").alias("piece"))
        )
        pieces = spread.distinct().select(F.xxhash64("block", "piece").alias("task"), "doc_id", F.col("doc_id").alias("known"))
        first = scratch.materialize(self._product(small.unionByName(pieces)), "ngram-links")
        rest = self._cross(own, first, limit)
        return first if rest is None else scratch.materialize(first.unionByName(self._product(rest)), "ngram-links")

    def _cross(self, own: DataFrame, first: DataFrame, limit: int) -> DataFrame | None:
        """Tasks for the rows of large blocks outside the block's main component, each with all pieces."""
        found = connected_components(first)
        known = own.join(found, own["doc_id"] == found["node"], "left").select(
            "block", "doc_id", "weight", "pieces", F.coalesce("component", "doc_id").alias("known")
        )
        known = scratch.materialize(known, "ngram-known")
        counts = known.groupBy("block", "known").agg(F.count(F.lit(1)).alias("held"))
        main = counts.groupBy("block").agg(F.max_by("known", F.struct("held", -F.col("known"))).alias("main"), F.count(F.lit(1)).alias("parts"))
        known = known.join(main.filter("parts > 1"), "block")
        outside = scratch.materialize(known.filter("known != main"), "ngram-outside")
        if outside.isEmpty():
            return None
        shares = outside.groupBy("block").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("shares"))
        task = F.xxhash64("block", "share", "piece")
        left = outside.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(1)), "shares")).withColumn("piece", numbers("pieces"))
        right = known.join(shares, "block").withColumn("piece", F.pmod(F.xxhash64("doc_id"), "pieces")).withColumn("share", numbers("shares"))
        columns = (task.alias("task"), "doc_id", "known")
        return left.select(*columns).unionByName(right.select(*columns)).distinct()

    def _product(self, tasks: DataFrame) -> DataFrame:
        return self._tasks(tasks, False).select("a", "b").distinct()

    def _tasks(self, tasks: DataFrame, counted: bool) -> DataFrame:
        wanted = self.texts.join(scratch.sized(scratch.materialize(tasks, "ngram-tasks")), "doc_id")
        return block_links(wanted, self.n, self.num, self.den, counted)

    def components(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, class_id; if counted, n_links (different sets that its own links with)."""
        found = connected_components(self.links)
        degree = self.degrees if self.counted else found.select(F.col("node").alias("x"), F.lit(0).cast("long").alias("n_links"))
        reps = found.join(degree, found["node"] == degree["x"], "left").select("node", "component", "n_links")
        # Members of large classes, of which there are few, look their class up by broadcast.
        few = F.broadcast(self.heavy.join(reps, F.col("rep") == F.col("node"), "left").select("rep", "node", "component", "n_links"))
        many = self.classes.join(F.broadcast(self.heavy), "rep", "left_anti")
        linked = many.join(reps, many["rep"] == reps["node"], "left").unionByName(self.classes.join(few, "rep")).select(
            "doc_id", "n_shingles", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        )
        empty = self.sets.filter("n_shingles = 0").select(
            "doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
        )
        return linked.unionByName(empty).select("doc_id", "n_shingles", "component_id", "class_id", *(["n_links"] if self.counted else []))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that link, directly or not, with one of a smaller id."""
    rows = NgramJoin(docs, n, num, den, id_col, text_col, counted=False).components()
    drop = scratch.materialize(rows.filter("component_id != doc_id").select(F.col("doc_id").alias("__drop")), "ngram-drop")
    return docs.join(scratch.sized(drop), docs[id_col] == drop["__drop"], "left_anti")

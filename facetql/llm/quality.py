"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text: trigrams of byte classes (letters by case, digits, white space, each punctuation
sign), hashed byte trigrams, and word repetition (words equal to the one before, words seen before in
the text).  The model is fitted on labelled rows: the ``TERMS`` most frequent terms, tf-idf, and a truncated
SVD to ``DIMENSIONS``.  At most ``sample`` labelled rows are used, half of them of each label where there are that
many, chosen by a hash of the id; this bounds what is broadcast (about 2 MB) at any input size.

Every document is projected the same way; cosines with all labelled vectors are exact products, block by
block, and the ``neighbours`` nearest labels are averaged with weights ``similarity ** sharpness``.

Null, empty and blank texts have no terms and get the labels' mean.  Labels that are null, or that
disagree for an id, are left out.  Without any label every score is 0.5.  Scoring keeps one output row per input row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import batches, hashed

SAMPLE, TERMS, DIMENSIONS = 4096, 2048, 48
NEIGHBOURS, SHARPNESS, BLOCK = 15, 8, 1024
CLASSES, HASHED, REPEATS = 32, 1024, 8
WIDTH = CLASSES**3 + HASHED + REPEATS


def _classes() -> np.ndarray:
    out = np.full(256, 31, np.int64)
    out[0:32] = 30
    out[[32, 9]] = 0
    out[[10, 13]] = 1
    out[48:58] = 2
    out[65:91] = 3
    out[97:123] = 4
    out[128:] = 5
    for i, sign in enumerate(b".,!?;:|-_*#%&$@/\\()<>\"'+="):
        out[sign] = 6 + min(i, 23)
    return out


CLASS_OF = _classes()


def term_counts(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Counts of all WIDTH terms for each text."""
    for lo, hi in batches(texts):
        words, at = hashed(texts[lo:hi])
        for i, t in enumerate(texts[lo:hi]):
            own = words[at[i] : at[i + 1]]
            if not len(own):
                yield np.zeros(WIDTH)
                continue
            b = np.frombuffer(t, np.uint8)
            if len(b) < 3:
                b = np.concatenate([b, np.full(3 - len(b), 32, np.uint8)])
            c = CLASS_OF[b]
            shape = np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
            v = b.astype(np.int64)
            sign = np.bincount((v[:-2] * 7919 + v[1:-1] * 104729 + v[2:] * 1299709 >> 3) % HASHED, minlength=HASHED)
            again = np.count_nonzero(own[1:] == own[:-1]) / len(own)
            seen = 1 - len(np.unique(own)) / len(own)
            repeats = np.zeros(REPEATS)
            repeats[int(again * 3.999)] = len(b)
            repeats[4 + int(seen * 3.999)] = len(b) / 4
            yield np.concatenate([shape, sign, repeats])


class Model(NamedTuple):
    terms: np.ndarray  # numbers of the terms used
    idf: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of length 1
    labels: np.ndarray
    prior: float

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = self.weigh(counts).astype(np.float32) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
        out = np.full(len(vectors), self.prior)
        if not len(self.vectors):
            return out
        k = min(neighbours, len(self.vectors))
        for lo in range(0, len(vectors), BLOCK):
            cosines = vectors[lo : lo + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(float) ** sharpness
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[lo : lo + BLOCK] = np.where(total > 0, vote / np.maximum(total, 1e-300), self.prior)
        return np.clip(out, 0, 1)


def _scores(model: Model, texts: list[bytes]) -> np.ndarray:
    counts = np.array([c[model.terms] for c in term_counts(texts)], np.float32).reshape(len(texts), len(model.terms))
    blank = ~counts.any(axis=1)
    out = model.scores(model.project(counts))
    out[blank] = model.prior
    return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def labelled_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Learnable (id, label): one row per id whose labels agree, without the held-out fold."""
    agreed = (
        labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).cast("long").alias("lid"))
        .agg(F.min(label_col).alias("label"), F.max(label_col).alias("most"))
    )
    return agreed.filter("label = most and label in (0, 1)").drop("most")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    known = labelled_ids(labels, id_col, label_col)
    mean = known.agg(F.avg("label").alias("p")).collect()[0]["p"]
    halves = [known.filter(F.col("label") == x).orderBy(F.xxhash64("lid"), "lid").limit(sample // 2) for x in (0, 1)]
    chosen = halves[0].unionByName(halves[1])  # at most ``sample`` rows

    def count(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            rows = [(np.flatnonzero(c).astype(np.int32), c[c > 0].astype(np.float32)) for c in term_counts(texts)]
            yield pa.RecordBatch.from_pydict(
                {
                    "lid": batch.column(0),
                    "label": batch.column(1).cast(pa.int32()),
                    "term": pa.array([r[0].tobytes() for r in rows], pa.binary()),
                    "n": pa.array([r[1].tobytes() for r in rows], pa.binary()),
                }
            )

    texts = docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).cast("binary").alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), "lid")
        .groupBy("lid")
        .agg(F.min(F.struct("label", "text")).alias("least"))  # of rows that share an id always the same one
        .select("lid", "least.label", "least.text")
        .mapInArrow(count, "lid long, label int, term binary, n binary")
        .collect()
    )
    rows = sorted((r for r in rows if len(r["term"])), key=lambda r: r["lid"])
    if not rows:
        none = np.zeros((0, DIMENSIONS), np.float32)
        return Model(np.arange(1), np.ones(1), np.zeros((1, DIMENSIONS), np.float32), none, np.zeros(0), 0.5 if mean is None else mean)
    sparse = [(np.frombuffer(r["term"], np.int32), np.frombuffer(r["n"], np.float32)) for r in rows]
    df = np.zeros(WIDTH)
    for term, _ in sparse:
        df[term] += 1
    terms = np.sort(np.argsort(-df, kind="stable")[:TERMS])
    terms = terms[df[terms] > 0]
    place = np.full(WIDTH, -1)
    place[terms] = np.arange(len(terms))
    counts = np.zeros((len(rows), len(terms)), np.float32)
    for i, (term, n) in enumerate(sparse):
        used = place[term] >= 0
        counts[i, place[term][used]] = n[used]
    idf = np.log((1 + len(rows)) / (1 + df[terms])) + 1
    model = Model(terms, idf, np.zeros((len(terms), 1), np.float32), np.zeros((0, 1)), np.array([r["label"] for r in rows], float), float(mean))
    x = model.weigh(counts).astype(np.float32)
    axes = principal_axes(x, min(DIMENSIONS, *x.shape))
    model = model._replace(axes=axes)
    return model._replace(vectors=model.project(counts).astype(np.float32))


def principal_axes(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """The k leading right singular vectors, by subspace iteration from a fixed start."""
    gram = x.T @ x
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(k + 8, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(gram @ q)
    _, vectors = np.linalg.eigh(q.T @ gram @ q)
    return np.ascontiguousarray((q @ vectors)[:, ::-1][:, :k]).astype(np.float32)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted, held_out."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches_:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            values = [_scores(own, texts[lo : lo + BLOCK]) for lo in range(0, len(texts), BLOCK)]
            values = np.concatenate(values) if values else np.empty(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(values)})

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    scored = columns.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", held_out(F.col("doc_id")))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, their columns unchanged, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    place = docs.columns.index(text_col)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches_:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                texts = [(t or "").encode() for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(_scores(own, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)

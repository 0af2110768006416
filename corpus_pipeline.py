"""Corpus pipeline over ``documents``: quality, exact copies, near copies, source mix, packing.

Each stage takes what its predecessor kept, written as Parquet and read again, and calls one operator of
``facetql.llm``.  All but the last keep the columns of ``documents``; the mix repeats rows as often as it takes
them and cuts the one row at the edge of a source's target to its first words.  A stage's scratch tables are deleted
when the next one starts, by then its result has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetql.llm import exact_dedup, mixing, ngram_join, packing, quality, scratch
from facetql.llm.queries import tokenizer_path
from facetql.llm.ship import ship


def _start(spark: SparkSession) -> None:
    scratch.release()
    ship(spark)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote rejects go."""
    _start(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the largest id."""
    _start(spark)
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at a Jaccard similarity of 0.8 of its five-word shingles stays."""
    _start(spark)
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a row stands once for each time it is taken."""
    _start(spark)
    return mixing.repeat_rows(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    _start(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: SQL has neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write_apart(docs, f"stage-{k}")
    return docs

"""Queries over the training-data tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extract, line_dedup, media, mixing, ngram_join, packing, quality, scratch, token_shards, warc
from .ship import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file; the package that holds them is the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.NgramJoin(_table(spark, sf_dir, "documents"), n=3, num=90, den=100).components()


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = scratch.new_path(spark, "token-shards")
    manifest = token_shards.write_shards(_table(spark, sf_dir, "documents"), directory, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_shards.read_shards(spark, manifest)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.LineDedup(_table(spark, sf_dir, "documents"), k=2).counts()


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = scratch.materialize(media.store_text(_table(spark, sf_dir, "documents")), "media")
    return media.media_features(stored)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("bucket")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = scratch.new_path(spark, "warc-derived")
    files = warc.write_derivatives(warc.response_column(_table(spark, sf_dir, "pages")), directory)
    records = warc.read_records(spark, directory, files)
    return records.withColumn("block_sha256", F.sha2("block", 256)).withColumnRenamed("key", "page_id").drop("block")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_quality": op2_quality,
        "op3_token_shards": op3_token_shards,
        "op4_line_dedup": op4_line_dedup,
        "op5_media_columns": op5_media_columns,
        "op6_packing": op6_packing,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_warc_derivatives": op8_warc_derivatives,
        "op9_mixing": op9_mixing,
        "op10_html_extract": op10_html_extract,
    }


OP7_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.UPPER.lower()}') AS body FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(body) AS text_sha256
FROM t
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|42') AS ord,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
             1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s),
f AS (SELECT *, row_number() OVER o AS k,
             coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent,
             (sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS left_weight
      FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
l AS (SELECT (total - spent) / left_weight AS level FROM f
      WHERE 2 * source_size >= (total - spent) / left_weight * weight ORDER BY k LIMIT 1),
t AS (SELECT source, source_size,
             coalesce(least(2.0::DOUBLE * source_size, (SELECT level FROM l) * weight), 2.0::DOUBLE * source_size) AS target FROM w),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       whole * size + greatest(0, least(size, floor(target - whole * source_size + 0.5)::BIGINT - start)) AS taken
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op9_mixing": OP9_SQL}

"""The ten registered queries and the SQL of those that DuckDB can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard, licenses, line_dedup, mixing, packing, ppm, quality, sharding, url_filter
from .shared import LOWER, UPPER


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    """The vocabulary file's place: RELIQUARY_TOKENIZER, or the public package's own."""
    if given := os.environ.get("RELIQUARY_TOKENIZER"):
        return given
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_documents(spark, sf_dir), min_docs=10)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path(), size=4096, end=1)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_documents(spark, sf_dir), order=5, folds=7, fold=2)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir), keep="max")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_documents(spark, sf_dir), width=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


def op9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_documents(spark, sf_dir), width=4, num=85, den=100).select("doc_id", "n_shingles", "set_id", "component_id", "n_links")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_packing, op4_lm_scoring, op5_exact_dedup, op6_mixing, op7_quality, op8_license_scan, op9_jaccard, op9_links, op10_url_filters)}

OP5_SQL = f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM n WINDOW g AS (PARTITION BY h)"""

ORACLE_SQL = {"op1_line_dedup": line_dedup.ORACLE, "op5_exact_dedup": OP5_SQL, "op6_mixing": mixing.oracle(), "op9_jaccard": jaccard.ORACLE, "op9_links": jaccard.LINKS_ORACLE, "op10_url_filters": url_filter.oracle()}

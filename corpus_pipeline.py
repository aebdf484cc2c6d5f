"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. run() applies them
all. A stage deletes the scratch tables of the one that its thread ran before, whose output must be
written by then. Every stage takes empty tables and columns of any name, and null ids and texts.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from reliquary.llm import jaccard, line_dedup, mixing, packing, quality, shared
from reliquary.llm.queries import tokenizer_path

#: Scratch tables of the stage that a thread ran last.
_last = threading.local()


def _clear(spark: SparkSession) -> None:
    shared.release(spark, getattr(_last, "paths", []))
    _last.paths = []


def _stage(work):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark)
        before = set(shared.made())
        out = work(spark, docs, sf_dir)
        _last.paths = [p for p in shared.made() if p not in before]
        return out

    stage.__doc__ = work.__doc__
    return stage


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that fail the rules or the trees go, null and empty texts among them;
    rows that repeat an id with the same text share their verdict."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of lines found in ten documents or more, the first occurrence stays. Documents all
    of whose lines went elsewhere stay with an empty text; a null text stays null."""
    return line_dedup.dedup_lines(docs, min_docs=10, keep_first=True)


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group linked by 5-word shingles at 0.8 stays, the smallest id.
    Texts without a word are alone and stay; a null id stays where its group has no other."""
    return jaccard.one_of_each(docs, width=5, num=80, den=100)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents are left out or repeated until sources have their target weights; a null
    source is one, and ties in size go by doc_id."""
    return mixing.mixed_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token sequences of 4096; a null or empty text has its end id only, and rows that
    come several times are packed each."""
    return packing.pack_documents(docs, tokenizer_path(), size=4096, end=1)


STAGES = [("quality rules", keep_quality), ("line dedup", dedup_lines), ("n-gram Jaccard join", one_of_each), ("mixing", mix_sources), ("packing", pack)]

#: Trees, tokens and packing have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared.shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with shared.batches_of(spark, 2000), shared.settings(spark, shared.DROP_SHUFFLES):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    _clear(spark)
    return docs

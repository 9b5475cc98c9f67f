"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, packing.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import decontaminate, packing, quality_rules, simhash_dedup
from eventloom.sources import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    scratch.prepare(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8) stays: the one with the smallest doc_id."""
    scratch.prepare(spark)
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    scratch.prepare(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, each with its place in a sequence of at most 2048 tokens."""
    scratch.prepare(spark)
    return packing.pack(docs, "byte_bpe_50k.json", capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Fingerprints, weak supervision and token ids can't be expressed in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; all but the last are written under the shared folder and read again.

    A stage's scratch tables, and what the stage before it wrote, go as soon as its own result is written.  The last
    stage's remain for the result that is handed out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        with scratch.recording() as made:
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                path = f"{folder}/{k}-{name}"
                docs.write.parquet(path)
                docs = spark.read.parquet(path)
                for old in [*made, *([before] if before else [])]:
                    scratch.drop(spark, old)
                before = path
    return docs

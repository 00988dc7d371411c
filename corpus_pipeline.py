"""The corpus pipeline: from raw documents to token ids. Each stage takes what the one before kept, written as Parquet.

A stage is a function of (spark, docs, sf_dir); all but the last give back the columns of docs. Nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waygrid.llm import bpe, decontamination, exact_dedup, language_id, near_dedup
from waygrid.llm.common import stage_table
from waygrid.llm.queries import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language cannot be told: no letter, or no difference between the best two."""
    return language_id.identify(docs, language_id.fit(docs), drop=True)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, A-Z lower-cased: that of the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near copies, five-word shingles, similarity 0.8 or more: that of the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a ten-word window of the benchmark."""
    return decontamination.find_hits(docs, table(spark, sf_dir, "benchmark"), drop=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, keep_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("byte_level_bpe", encode),
]

#: Compression, components of a similarity graph and BPE are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

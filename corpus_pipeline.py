"""A corpus pipeline: quality, line runs, near-duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. The first four return the columns of documents; the last returns the
ids' digests, as operator 10 does. `run` writes each stage's result and reads
it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileforge.llm import bpe, decontaminate, line_dedup, near_dup, quality_model
from tileforge.llm.common import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of docs, scores 0.5 or more."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs of 50 words or more; what is left without words by this goes."""
    cleaned = line_dedup.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, that of the smallest doc_id."""
    return near_dup.without_copies(docs).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text."""
    return bpe.digests(docs, bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_runs),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("byte_bpe", token_ids),
]

#: The classifier's fit has no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs

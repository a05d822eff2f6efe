"""The corpus pipeline: toxicity, near-dedup, decontamination, secrets, tokens.

Each stage works on all that the one before kept; results go to Parquet in the
shared folder between stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinequery.llm import decontam, near_copies, secrets, sentencepiece, toxicity
from cinequery.llm.common import Scratch, table
from cinequery.llm.queries import MODEL_PATH


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose noisy-or of sentence scores is 0.5 or more."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest doc_id, of each group of near copies: five-word shingles, similarity 0.8."""
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, copied or edited."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces its secrets."""
    return secrets.redact(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, with proof that they decode to its text."""
    return sentencepiece.tokenize(docs, MODEL_PATH)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Learnt scores and Viterbi segmentation have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Rows with null or empty texts are clean documents like any other; a null doc_id is carried along; an empty table gives no rows."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)

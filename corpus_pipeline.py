"""Corpus preparation in five stages; each reads what the one before it kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents, in
their order, further columns included. Null texts are scored as empty ones, linked with nothing, leak nothing, stay
null, and are packed as their end id. Rows with a null id are never copies or leaks. Rows that repeat an id are one
document after near_dedup. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremill.llm import decontam, neardup, packing, pii, quality
from theoremill.llm.common import table
from theoremill.plans.scratch import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier (fitted on labels of rows that are not held out) rejects."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return neardup.keep_one(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item, as it is or re-parameterised."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts; n_chars follows the new text."""
    made = pii.replace_pii(docs).drop("pii_spans")
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 1024 tokens."""
    made = packing.pack(docs, digest={"ids_crc32": F.crc32})
    return made.select("doc_id", "start", "length", "ids_crc32", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("pack_sequences", pack_sequences),
]

#: Stages with trained models, signatures and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

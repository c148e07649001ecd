"""Corpus pipeline: STAGES of (name, function), each called with (spark, docs, sf_dir).

Every stage works on all rows of the stage before it and returns the columns of ``documents``; the last
returns the encoded documents. Stages communicate by Parquet in the shared folder alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siglume.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_classifier
from siglume.llm.common import OWN, discard, materialize, settle, table
from siglume.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weak-label classifier calls low quality or toxic."""
    rated = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), prefix=OWN)
    return rated.where(f"{OWN}kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; ``n_chars`` follows. A document all of whose lines stand elsewhere goes."""
    own = {c: f"{OWN}{c}" for c in docs.columns if c.lower() in line_dedup.COUNTS}  # columns that the operator would replace
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    out = out.where((F.col("n_exact") + F.col("n_near") == 0) | F.col("text").rlike(r"[^\s]"))
    out = out.drop(*line_dedup.COUNTS).withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles at Jaccard 0.8 or more connect."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, mode="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("bpe", encode),
]

#: The classifier's training and the tokenizer can't be expressed in SQL. tests/llm holds the stages after the classifier
#: against brute-force versions, the encoder against the tokenizers library and the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(done)  # the tables between stages; the input has no scratch of its own
        settle(spark)
    return STAGES[-1][1](spark, docs, sf_dir)

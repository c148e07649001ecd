"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, jaccard_join, line_dedup, oracles, pii, quality_classifier, quality_rules, sharding, suffix_dedup, url_filter
from .common import table


def vocabulary() -> str:
    """The byte-level vocabulary file of the box's public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a secret of the session where one is set; else a fresh one, so that nobody can undo the surrogates
    out = pii.replace(table(spark, sf_dir, "documents"), spark.conf.get("siglume.pii.key", None) or secrets.token_hex(32))
    kinds = F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"])))
    return out.select("doc_id", "text", "n_entities", F.array_join(kinds, ",").alias("kinds"), F.array_join(F.transform("entities", lambda e: e["surrogate"]), "\n").alias("surrogates"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(table(spark, sf_dir, "documents"), shards=16)
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(table(spark, sf_dir, "documents")).drop("lang", "source")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False).drop("round_trip")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_pii": op6_pii,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL

"""Queries of this subpackage for the driver, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import decontamination, hard_negatives, license_scan, line_dedup, near_dedup, packing, pii, prefix_trie, quality_classifier, quality_rules, secret_scan, sharding, substring_dedup
from heddle.llm.common import read

#: A deployment passes its own secret.
PSEUDONYM_KEY = "example key of the query catalogue"
SHARDS = {i: 1.0 for i in range(16)}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = secret_scan.fit_markov(secret_scan.labelled_samples(spark))
    return secret_scan.digest(secret_scan.find_secrets(read(spark, sf_dir, "documents"), ratios))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(read(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(read(spark, sf_dir, "documents"), SHARDS, grown=SHARDS | {16: 1.0})
    return out.withColumn("law", F.lit("key"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).withColumn("held_out", quality_classifier.held_out("doc_id"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_dedup.digest(docs, line_dedup.keep_bitmaps(docs))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), lambda id: id % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, sizes = prefix_trie.numbered_turns(read(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.borrowed(turns, sizes))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_pseudonyms, op3_secret_scan, op4_substring_dedup, op5_best_fit_packing, op6_sharding, op7_near_dedup, op8_quality_classifier, op9_license_scan, op10_decontamination, op11_line_dedup, op12_hard_negatives, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": substring_dedup.oracle(), "op7_near_dedup": near_dedup.oracle(), "op9_license_scan": license_scan.oracle(), "op10_decontamination": decontamination.oracle(), "op11_line_dedup": line_dedup.oracle(), "op12_hard_negatives": hard_negatives.oracle(), "op13_prefix_trie": prefix_trie.oracle()}

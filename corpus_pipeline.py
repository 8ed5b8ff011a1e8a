"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before it kept; what
a stage returns is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import decontamination, near_dedup, packing, pii, quality_classifier
from heddle.llm.common import dropped, read, scratch, written
from heddle.llm.queries import PSEUDONYM_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, fitted on the labels, rejects."""
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs.select(COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontamination.uncontaminated(docs.select(COLUMNS), read(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values in the texts."""
    named = pii.pseudonymize(docs, PSEUDONYM_KEY, carry=("lang", "source"))
    return named.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("pseudonyms", pseudonyms),
    ("best_fit_packing", packed),
]

#: Classifier and tokenizer can't be expressed in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.  Once a stage is written, the tables that it wrote
    for itself, and the stage before, are deleted."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch() as keep:
            docs = written(stage(spark, docs, sf_dir))
            keep.append(docs)
        if i:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)

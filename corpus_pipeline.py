"""Corpus pipeline: stages applied to ``documents``, each over all its predecessor kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, line_dedup, mix, quality, simhash
from palisade.llm.common import table, unused
from palisade.sources.scratch import scratch_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, fitted on the folder's labels, rejects."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"), metadata=["n_chars"])
    return quality.keep_good(docs, model, metadata=["n_chars"])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clears texts of aligned blocks that an earlier document holds. No document is dropped;
    ``n_chars`` follows its text where that has changed."""
    before = unused(docs, "_before")
    cleaned = line_dedup.dedup_lines(
        docs.withColumn(before, F.length("text")), whole=True)
    return cleaned.withColumn("n_chars", F.when(
        F.length("text") < F.col(before), F.length("text").cast("bigint")).otherwise(
        F.col("n_chars"))).drop(before)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold most of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources, languages and topics get their target shares."""
    return mix.sample(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

# No stage is expressible in SQL as a whole; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: quality, near duplicates, benchmark decontamination, PII, and the mix of sources.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns a frame; ``run`` writes each as
Parquet to the shared folder and reads it back as the next one's documents, so lost executors cost one stage at most.  All
but the last return the columns of the documents, in their order.  An empty table runs through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from milaan.llm.common import table
from milaan.llm.op01_mix import mix
from milaan.llm.op03_jaccard import one_of_each
from milaan.llm.op06_pii import pseudonymized
from milaan.llm.op09_quality import quality
from milaan.llm.op10_decontaminate import decontaminate
from milaan.sources.writers import scratch_path


NEEDED = ("doc_id", "text", "lang", "source")


def beside(docs: DataFrame, operator) -> DataFrame:
    """Run an operator on documents whose other columns have names that cannot clash; their values come back untouched."""
    names = [c if c in NEEDED else f"__extra{i}" for i, c in enumerate(docs.columns)]
    return operator(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go."""
    return beside(docs, lambda d: quality(d, table(spark, sf_dir, "labels")).filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id."""
    return beside(docs, one_of_each)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule calls contaminated go."""
    return beside(docs, lambda d: decontaminate(d, table(spark, sf_dir, "benchmark")).filter("NOT contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by surrogates; all documents stay."""
    return beside(docs, pseudonymized)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes, beside the document; columns of the mix replace documents' of the same name."""
    return mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii), ("mix_sources", mix_sources),
]
# The first four stages are no SQL; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Corpus preparation in stages, each one operator of ``fleetlens.llm``."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import bpe, decontaminate, exact_dedup, langid, near_dedup
from fleetlens.llm.common import documents, importable, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents teach stay."""
    return langid.accepted_documents(docs, langid.train(documents(spark, sf_dir)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates stays; shingles of five words."""
    return near_dedup.without_near_duplicates(docs, words=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, word by word or with its slots filled anew, go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the number of tokens of each text and whether decoding them gives the text back."""
    return bpe.with_token_counts(docs)


STAGES = [("language", known_language), ("exact dedup", exact_copies), ("near dedup", near_copies), ("decontamination", benchmark_leaks), ("tokens", tokenised)]

#: Language evidence, near duplicates and tokens cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


#: Rows of a batch that goes to Python. Spark's own 10,000 hold a whole partition of texts, in buffers of the executor and of Python, and the
#: workers of a stage keep that memory through the next ones.
BATCH, BATCH_ROWS, SPARK_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "500", "10000"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Batches of BATCH_ROWS rows, unless the session sets their size itself."""
    before = spark.conf.get(BATCH)
    if before == SPARK_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(importable(spark), sf_dir)
    with small_batches(spark):
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

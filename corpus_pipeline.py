"""The corpus pipeline: documents without toxic ones, boilerplate lines, near copies and benchmark text, packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coppice.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from coppice.sources.stored import drop, kept, scratch, written


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on five sources or more and in five texts or more go (copies count as one text); every document stays."""
    return line_dedup.remove_spread_lines(docs, min_sites=5, min_texts=5)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.keep_one(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of ten benchmark words in a row go, and documents that are mostly such spans."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_coverage=0.5)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", _toxicity), ("line_dedup", _lines), ("near_duplicates", _near), ("decontamination", _benchmark), ("packing", _pack)]

#: SQL can express neither the classifier nor the packing; tests/llm/test_odd_rows.py holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is a table that the next one reads; what a stage writes besides is deleted after it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = kept(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

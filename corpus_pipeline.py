"""Corpus pipeline: language, repeated passages, near duplicates, benchmark passages, source mix.

Each stage takes the documents that the one before it kept, is written as Parquet in the
shared folder and read again by the next one, so a lost executor costs one stage at most.
Every stage reads its whole input; its counts and statistics are those of its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwise import session
from tillwise.llm import decontamination, language, line_dedup, mixing, similar

# Near duplicates of the pipeline compare shingles of five words.
SHINGLE_WORDS = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language.keep_identified(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return line_dedup.without_repeats(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash and Golay keys, then the exact join."""
    return similar.keep_representatives(docs, SHINGLE_WORDS)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no considerable part of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often it takes them."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", remove_near_duplicates),
    ("benchmark_decontamination", remove_benchmark_passages),
    ("source_mixing", mix_sources),
]

# Suffix automata, alignment, hashes with seeds and a convex solver have no SQL; the tests
# compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = session.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

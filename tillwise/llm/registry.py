"""The registered queries of this package: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tillwise.llm import (
    chat,
    collocations,
    decontamination,
    exact_dedup,
    language,
    licenses,
    line_dedup,
    mixing,
    neural_scores,
    oracle,
    pii,
    simhash,
    token_counts,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


# The vocabulary of the token counts.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: the source and the language are their directories.

    Texts that are mostly license statements are the license files of their directory.
    """
    number = F.col("doc_id").cast("string")
    name = F.when(licenses.is_mostly_statements(F.col("text")), F.concat_ws(".", F.lit("LICENSE"), number)).otherwise(number)
    path = F.concat_ws("/", "source", "lang", name)
    return licenses.scan(_table(spark, folder, "documents").select("doc_id", path.alias("path"), "text"))


def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = token_counts.read_vocabulary(VOCABULARY)
    return token_counts.document_tokens(_table(spark, folder, "documents"), vocabulary)


def _line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.remove_repeats(_table(spark, folder, "documents"), ["doc_id"])
    return found.select(F.col("c0").alias("doc_id"), F.col("kept_text").alias("text"), "n_lines", "n_removed")


def _mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def _decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontamination.contamination(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark"), ["doc_id"]
    )
    return judged.withColumnRenamed("c0", "doc_id")


def _language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predictions(_table(spark, folder, "documents"))


def _pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.span_digests(pii.find_spans(_table(spark, folder, "documents")))


def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def _chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts consist of control strings."""
    odd = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, chat.USER).otherwise(chat.ASSISTANT).alias("role"),
        F.lit(odd).alias("text"),
    )
    conversations = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    events = chat.whole_messages(conversations.unionByName(planted))
    return chat.digests(chat.read_back(chat.format_conversations(events)))


def _exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


def _neural_scores(spark: SparkSession, folder: str) -> DataFrame:
    return neural_scores.scores(_table(spark, folder, "documents"))


def _collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def _whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


_QUERIES: dict[str, Query] = {
    "op1_licenses": _licenses,
    "op2_token_counts": _token_counts,
    "op3_line_dedup": _line_dedup,
    "op4_mixing": _mixing,
    "op5_decontamination": _decontamination,
    "op6_language": _language,
    "op7_pii": _pii,
    "op8_simhash": _simhash,
    "op9_chat": _chat,
    "op10_exact_dedup": _exact_dedup,
    "op11_neural_scores": _neural_scores,
    "op12_collocations": _collocations,
    "op13_whitening": _whitening,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {**oracle.SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}

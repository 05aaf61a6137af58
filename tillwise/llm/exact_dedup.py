"""Exact deduplication: tree merge of sorted digest runs.

Every row becomes an entry (digest, length, second hash, doc_id); the text itself is never
shuffled. Entries are dealt to ``runs`` runs by a hash of their doc_id. In each round
``fan_in`` neighbouring runs exchange their entries by digest, sort them and merge them in digest
order, keeping per text the identifier that stays and the number of rows. After
log(runs) / log(fan_in) rounds one run is left. A task merges at most ``fan_in`` entries of
a text, however many copies it has: copies within a run are combined before the first
exchange.

An entry agrees with another only if the SHA-256 digest, the byte length and an
independent 64-bit hash all agree, so every level verifies what it merges.

Defined cases: a null text counts as empty; a very long text is read once, only its digest
travels; a null doc_id stays only where all copies have
none; of repeated rows (same doc_id and text) one stays; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise import session

TEXT_KEY = ["digest", "n_bytes", "check"]


def text_entries(docs: DataFrame) -> DataFrame:
    """One entry per doc_id and text, with the number of rows that repeat it."""
    text = F.coalesce("text", F.lit(""))
    return (
        docs.select(
            "doc_id",
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(text).alias("check"),
        )
        .groupBy("doc_id", *TEXT_KEY)
        .agg(F.count("*").alias("copies"))
    )


def merge_runs(entries: DataFrame, runs: int = 64, fan_in: int = 4) -> DataFrame:
    """The entries merged to one per text: the identifier that stays and the number of rows.

    A round deals the runs it merges out by digest and sorts each part by digest and falling
    identifier. The windows walk the sorted entries: the first of a text goes on, with the
    rows of all of them, at most ``fan_in``.
    """
    level = (
        entries.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs)))
        .groupBy("run", *TEXT_KEY)
        .agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    )
    of_text = Window.partitionBy("run", *TEXT_KEY)
    merged = of_text.orderBy(F.desc_nulls_last("keep_id"))
    whole = merged.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while runs > 1:
        runs = -(-runs // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in))
            .withColumn("place", F.row_number().over(merged))
            .withColumn("group_size", F.sum("group_size").over(whole))
            .filter("place = 1")
            .drop("place")
        )
    return level.drop("run")


def exact_duplicates(docs: DataFrame, runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Entries and merged groups are
    stored, so that the last join reads two tables of known size and AQE can split the
    entries of a text with very many copies.
    """
    entries = session.stored(text_entries(docs), "text-entries")
    groups = merge_runs(entries, runs, fan_in).filter("group_size > 1")
    groups = session.stored(groups, "text-groups")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        entries.join(groups, TEXT_KEY, "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id",
            keep_id.alias("keep_id"),
            F.coalesce("group_size", "copies").alias("group_size"),
            (F.col("doc_id").eqNullSafe(keep_id) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )

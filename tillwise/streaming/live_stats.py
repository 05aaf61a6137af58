"""Store statistics kept current by a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillwise import session
from tillwise.operators import statistics

BATCH = "batch_id"
COMPACT_AFTER = 16


def start_live_stats(purchases: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Aggregate a stream of purchases; each micro-batch writes the stores it changed.

    Batch ``k`` is stored under the number ``2 k``. After every ``COMPACT_AFTER`` batches
    the latest statistics of all stores are stored under the next odd number and what came
    before is deleted, so the folder does not grow with the number of batches.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/{BATCH}={2 * batch_id}")
        if (batch_id + 1) % COMPACT_AFTER == 0:
            _compact(changed.sparkSession, folder, 2 * batch_id + 1)

    return (
        statistics.parts(purchases)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _compact(spark: SparkSession, folder: str, number: int) -> None:
    """Fold all updates before ``number`` into it; a replay finds the finished fold and keeps it."""
    target = f"{folder}/{BATCH}={number}"
    names = [name for name, *_ in session.listing(spark, folder) if name.startswith(f"{BATCH}=")]
    older = [name for name in names if int(name.partition("=")[2]) < number]
    is_done = f"{BATCH}={number}" in names and any(name == "_SUCCESS" for name, *_ in session.listing(spark, target))
    if not is_done:
        updates = spark.read.option("basePath", folder).parquet(*[f"{folder}/{name}" for name in older])
        _latest(updates).write.mode("overwrite").parquet(target)
    for name in older:
        session.remove(spark, f"{folder}/{name}")


def _latest(updates: DataFrame) -> DataFrame:
    values = [c for c in updates.columns if c not in ("store_id", BATCH)]
    latest = updates.groupBy("store_id").agg(F.max_by(F.struct(*values), BATCH).alias("latest"))
    return latest.select("store_id", "latest.*")


def current_stats(updates: DataFrame) -> DataFrame:
    """The latest written statistics of each store; ``updates`` reads the stream's folder."""
    return statistics.finish(_latest(updates))

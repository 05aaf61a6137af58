"""Average discounts rounded at every sale, kept in keyed state of a stream.

The state of a store is the number of its sales and its average in hundredths of a percent, two
numbers in a RocksDB state store, whatever has come before. A micro-batch brings a store's new
sales, which count in the order (txn_date, numeric purchase id), as in
:func:`tillwise.operators.statistics.step_rounded_average`; batches count in the order they come. After
twice the declared range the average cannot move any more, so of a batch the first sales up
to that bound are held and the others are only counted.

Spark keeps the state with the checkpoint: a restart goes on behind the last batch, a batch
that is run again starts from the state before it.

Defined cases: a discount that is missing or outside the declared range counts as a sale and
leaves the average as it is; a store that has only such sales has no average; sales without a
store are left out; a batch without sales of a store leaves its row as it was.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tillwise import schema, session
from tillwise.functions.text import as_number

PROVIDER_CLASS = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "n bigint, cents bigint"
UPDATES = "store_id bigint, num_purchases bigint, cents bigint"


def rounded(total: int, count: int) -> int:
    """total / count, half away from zero."""
    quotient = (2 * abs(total) + count) // (2 * count)
    return quotient if total >= 0 else -quotient


class StepRounded(StatefulProcessor):
    """One store: its new sales are folded into its number of sales and its average."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        low, high = schema.DISCOUNT_RANGE
        self.moving = 2 * 100 * (high - low)
        self.state = handle.getValueState("average", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, cents = self.state.get() if self.state.exists() else (0, None)
        room, came, first = max(self.moving - n, 0), 0, []
        for batch in rows:
            came += len(batch)
            if room:
                sales = zip(batch["day"], batch["number"], batch["purchase_id"], batch["discount"])
                first = heapq.nsmallest(room, [*first, *((d, _last(k), i, p) for d, k, i, p in sales)])
        for place, (_, _, _, discount) in enumerate(first):
            if discount is not None and discount == discount:
                discount = int(discount)
                cents = discount if cents is None else rounded(cents * (n + place) + discount, n + place + 1)
        self.state.update((n + came, cents))
        yield pd.DataFrame({"store_id": [int(key[0])], "num_purchases": [n + came], "cents": pd.array([cents], dtype="Int64")})

    def close(self) -> None:
        pass


def _last(number) -> int:
    """Ids that are no numbers come first, as nulls do in an ascending order."""
    return -1 if number is None or number != number else int(number)


def start_rounded_stats(sales: DataFrame, updates: str, checkpoint: str) -> StreamingQuery:
    """Fold everything available in the stream of sales into the state, and stop.

    Every store that a batch changes is a row in ``updates``, one directory per batch.
    """
    in_range = F.col("discount_percent").between(*schema.DISCOUNT_RANGE)
    keyed = sales.filter("store_id IS NOT NULL").select(
        F.col("store_id").cast("bigint").alias("store_id"),
        F.unix_date("txn_date").alias("day"),
        as_number(F.col("purchase_id")).alias("number"),
        "purchase_id",
        F.when(in_range, F.col("discount_percent").cast("bigint") * 100).alias("discount"),
    )
    folded = keyed.groupBy("store_id").transformWithStateInPandas(
        statefulProcessor=StepRounded(), outputStructType=UPDATES, outputMode="Update", timeMode="None"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch_id={batch_id}")

    writer = folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    with session.setting(sales.sparkSession, PROVIDER_CLASS, PROVIDER):
        # A stream keeps the settings it was started with.
        return writer.trigger(availableNow=True).start()


def current_averages(updates: DataFrame) -> DataFrame:
    """Number of sales and average discount of each store after the last batch that changed it."""
    latest = updates.groupBy("store_id").agg(F.max_by(F.struct("num_purchases", "cents"), "num_purchases").alias("latest"))
    hundredth = F.lit("0.01").cast("decimal(2,2)")
    average = (F.col("latest.cents") * hundredth).cast("decimal(5,2)").alias("avg_discount")
    return latest.select("store_id", F.col("latest.num_purchases").alias("num_purchases"), average)

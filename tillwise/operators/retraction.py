"""Store statistics that follow deletions and renames without the sales that stay.

Sums and counts are kept per store and location, where a deleted or renamed store is a row
that goes or moves. Smallest and largest prices cannot be taken back from themselves, so
the number of sales at each price is kept as well: a price goes with its last sale. Sales
that are removed one by one (those of a deleted customer) are counted and subtracted; the
sales that stay are never read.

Defined cases: stores or locations that are NULL are groups of their own; a store without
sales left has no row; removing sales that were never counted is an error of the caller and
shows as negative counts, which :meth:`StoreStats.negative` returns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.money import sale_price, total
from tillwise.operators import statistics
from tillwise.operators.cascade import NEW

STORE = ["store_id", "store_location"]


@dataclass(frozen=True)
class StoreStats:
    """``sums`` has a row per store and location, ``prices`` one for each sale price there."""

    sums: DataFrame
    prices: DataFrame

    @classmethod
    def of(cls, sales: DataFrame) -> StoreStats:
        sale = sale_price(F.col("purchased_product_price_usd"), F.col("discount_percent"))
        sums = sales.groupBy(*STORE).agg(
            total(sale).cast("decimal(20,2)").alias("total_sales"),
            F.count("*").alias("num_purchases"),
            F.coalesce(F.sum("discount_percent"), F.lit(0)).cast("bigint").alias("discount_total"),
            F.count("discount_percent").alias("discount_count"),
        )
        priced = sales.select(*STORE, sale.cast("decimal(12,2)").alias("price")).filter("price IS NOT NULL")
        return cls(sums, priced.groupBy(*STORE, "price").agg(F.count("*").alias("n")))

    def plus(self, other: StoreStats) -> StoreStats:
        return self._added(other, 1)

    def minus(self, other: StoreStats) -> StoreStats:
        """Without the sales that ``other`` counts."""
        return self._added(other, -1)

    def without_stores(self, removed: DataFrame) -> StoreStats:
        """Without the stores (keys) and all of their sales."""
        return StoreStats(*(rows.join(removed.select(*STORE), STORE, "left_anti") for rows in (self.sums, self.prices)))

    def with_stores_renamed(self, renamed: DataFrame) -> StoreStats:
        """With the key of some stores replaced by ``new_store_id`` and ``new_store_location``."""
        return StoreStats(*(self._renamed(rows, renamed) for rows in (self.sums, self.prices)))._regrouped()

    def finish(self) -> DataFrame:
        """The reported columns per store id."""
        sums = self.sums.groupBy("store_id").agg(
            *[F.sum(name).cast(self.sums.schema[name].dataType).alias(name) for name in statistics.SUMS]
        )
        extremes = self.prices.groupBy(F.col("store_id").alias("of_store")).agg(
            F.min("price").alias("min_price"), F.max("price").alias("max_price")
        )
        joined = sums.join(extremes, F.col("store_id").eqNullSafe(F.col("of_store")), "left").drop("of_store")
        return statistics.finish(joined)

    def negative(self) -> DataFrame:
        """Rows that more has been taken from than they had."""
        return self.prices.filter("n < 0")

    def _added(self, other: StoreStats, sign: int) -> StoreStats:
        def signed(rows: DataFrame, names: list[str]) -> DataFrame:
            return rows.withColumns({name: (F.col(name) * sign).cast(rows.schema[name].dataType) for name in names})

        sums = self.sums.unionByName(signed(other.sums, statistics.SUMS))
        return StoreStats(sums, self.prices.unionByName(signed(other.prices, ["n"])))._regrouped()

    def _regrouped(self) -> StoreStats:
        sums = self.sums.groupBy(*STORE).agg(
            *[F.sum(name).cast(self.sums.schema[name].dataType).alias(name) for name in statistics.SUMS]
        )
        prices = self.prices.groupBy(*STORE, "price").agg(F.sum("n").alias("n"))
        return StoreStats(sums.filter("num_purchases <> 0"), prices.filter("n <> 0"))

    @staticmethod
    def _renamed(rows: DataFrame, renamed: DataFrame) -> DataFrame:
        new = {c: F.coalesce(F.col(NEW + c), F.col(c)).cast(rows.schema[c].dataType) for c in STORE}
        keys = renamed.select(*STORE, *[NEW + c for c in STORE])
        return rows.join(keys, STORE, "left").withColumns(new).select(*rows.columns)

"""Sales statistics per store id: full rebuild, exact merge, and step-rounded averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise import schema
from tillwise.functions.money import divided, exact_average, sale_price, total
from tillwise.functions.text import as_number

SUMS = ["total_sales", "num_purchases", "discount_total", "discount_count"]
HUNDREDTH = "0.01"
RANK_SLICES = 64
STORED = "mv_store_sales_stats"


def parts(purchase: DataFrame) -> DataFrame:
    """Mergeable statistics: sums, count and extremes of the sale price per store id."""
    sale = sale_price(F.col("purchased_product_price_usd"), F.col("discount_percent"))
    return purchase.groupBy("store_id").agg(
        total(sale).cast("decimal(20,2)").alias("total_sales"),
        F.count("*").alias("num_purchases"),
        F.coalesce(F.sum("discount_percent"), F.lit(0)).cast("bigint").alias("discount_total"),
        F.count("discount_percent").alias("discount_count"),
        F.min(sale).cast("decimal(12,2)").alias("min_price"),
        F.max(sale).cast("decimal(12,2)").alias("max_price"),
    )


def merge(*batches: DataFrame) -> DataFrame:
    """Combine mergeable statistics; order and grouping of the batches do not matter."""
    combined = batches[0]
    for batch in batches[1:]:
        combined = combined.unionByName(batch)
    return combined.groupBy("store_id").agg(
        *[F.sum(name).cast(combined.schema[name].dataType).alias(name) for name in SUMS],
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
    )


def finish(merged: DataFrame) -> DataFrame:
    """The reported columns, with the exact average of the discounts that are known.

    An average that does not fit the declared column (discounts far outside the declared
    range, see :func:`discount_outliers`) is NULL.
    """
    average = exact_average(F.col("discount_total") * 100, F.col("discount_count"), 2)
    return merged.select(
        "store_id",
        "total_sales",
        "num_purchases",
        average.try_cast("decimal(5,2)").alias("avg_discount"),
        "min_price",
        "max_price",
    )


def write_stored(merged: DataFrame, folder: str) -> None:
    """Store mergeable statistics and the reported table made from them."""
    merged.write.mode("overwrite").parquet(f"{folder}/parts")
    kept = read_parts(merged.sparkSession, folder, merged.schema)
    schema.conform(finish(kept), STORED).write.mode("overwrite").parquet(f"{folder}/{STORED}")


def read_parts(spark: SparkSession, folder: str, declared=None) -> DataFrame:
    reader = spark.read.schema(declared) if declared is not None else spark.read
    return reader.parquet(f"{folder}/parts")


def refresh_stored(spark: SparkSession, folder: str, delta: DataFrame, target: str) -> None:
    """Merge the statistics of new sales into stored ones, as a new version in ``target``.

    Only the stored statistics and the delta are read, never the sales before.
    """
    write_stored(merge(read_parts(spark, folder, delta.schema), delta), target)


def read_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The reported table as stored."""
    return spark.read.schema(schema.TABLES[STORED]).parquet(f"{folder}/{STORED}")


def discount_outliers(purchase: DataFrame) -> DataFrame:
    """Sales without a discount in the declared range; they count, but a stepwise average leaves them out."""
    return purchase.filter(~F.coalesce(F.col("discount_percent").between(*schema.DISCOUNT_RANGE), F.lit(False)))


def step_rounded_average(purchase: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Average discount when it is rounded to cents after every single sale.

    ``stored`` holds ``store_id, num_purchases, avg_discount`` from before. All sales count, in
    the order (txn_date, numeric purchase id); those of :func:`discount_outliers` leave the
    average as it is, and a store that has only such sales has none.

    In hundredths of a percent, sale number ``n + 1`` moves the average ``a`` to
    ``a + (d - a) / (n + 1)``, rounded. Both lie in the declared range, so once ``n + 1``
    exceeds twice its width the average can never move again. The fold therefore needs only
    that many first sales of a store (20,000), whatever the store's total, and is exact.
    The first sales are found in slices of a store first, so that no task ranks all sales
    of a store and each slice passes on no more than the bound.
    """
    sales = purchase.filter(F.col("store_id").isNotNull())
    in_range = F.col("discount_percent").between(*schema.DISCOUNT_RANGE)
    discount = F.when(in_range, F.col("discount_percent").cast("bigint") * 100)
    low, high = schema.DISCOUNT_RANGE
    moving = 2 * 100 * (high - low)
    added = sales.groupBy("store_id").agg(F.count("*").alias("added"))
    if stored is None:
        start = added.withColumns({"n0": F.lit(0).cast("bigint"), "a0": F.lit(None).cast("bigint")})
    else:
        before = stored.select(
            "store_id",
            F.col("num_purchases").cast("bigint").alias("n0"),
            (F.col("avg_discount") * 100).cast("bigint").alias("a0"),
        )
        start = added.join(before, "store_id", "left").fillna(0, ["n0"])

    number = as_number(F.col("purchase_id"))
    order = ["txn_date", "number", "purchase_id"]
    in_slice = Window.partitionBy("store_id", "rank_slice").orderBy(*order)
    in_store = Window.partitionBy("store_id").orderBy(*order)
    early = (
        sales.select("store_id", "txn_date", number.alias("number"), "purchase_id", discount.alias("d"))
        .withColumn("rank_slice", F.pmod(F.xxhash64("purchase_id"), F.lit(RANK_SLICES)))
        .withColumn("position", F.row_number().over(in_slice))
        .filter(F.col("position") <= moving)
        .withColumn("position", F.row_number().over(in_store))
        .filter(F.col("position") <= moving)
        .groupBy("store_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "d"))).alias("sales"))
    )
    folded = F.aggregate(
        "sales",
        F.struct(F.col("a0").alias("a"), F.col("n0").alias("n")),
        lambda state, sale: F.struct(
            F.coalesce(divided(state["a"] * state["n"] + sale["d"], state["n"] + 1), state["a"], sale["d"]).alias("a"),
            (state["n"] + 1).alias("n"),
        ),
        lambda state: state["a"],
    )
    hundredth = F.lit(HUNDREDTH).cast("decimal(2,2)")
    return early.join(start, "store_id").select(
        "store_id",
        (F.col("n0") + F.col("added")).alias("num_purchases"),
        (folded * hundredth).cast("decimal(5,2)").alias("avg_discount"),
    )

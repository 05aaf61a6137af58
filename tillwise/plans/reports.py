"""Named reports: retail tables in, one DataFrame out.

Large inputs are aggregated before they are joined. The aggregate combines on the map
side, so a customer, item or store that holds a third of all rows reaches the shuffle as
one row per task, and its hash partitioning is the one the following join needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.ages import age_group, age_range
from tillwise.functions.money import exact_average, sale_price, total, whole_units
from tillwise.functions.text import as_number, contact_email, same_text
from tillwise.operators import statistics
from tillwise.schema import NECESSITIES
from tillwise.sources.tables import RetailTables

STORE = ["store_id", "store_location"]
ITEM = ["product_id", "store_id", "store_location"]
PRICE = "purchased_product_price_usd"


def _sale() -> Column:
    return sale_price(F.col(PRICE), F.col("discount_percent"))


def store_performance(tables: RetailTables) -> DataFrame:
    """Transactions, revenue before discount and average foot traffic of every store."""
    sales = tables.purchase.groupBy(*STORE).agg(
        F.count("*").alias("total_transactions"), total(F.col(PRICE)).alias("total_revenue")
    )
    traffic = tables.popularity.groupBy(*STORE).agg(
        exact_average(F.sum("foot_traffic") * 10000, F.count("foot_traffic"), 4).alias("avg_foot_traffic")
    )
    return (
        tables.store.select(*STORE)
        .join(sales, STORE, "left")
        .join(traffic, STORE, "left")
        .select(
            *STORE,
            F.coalesce("total_transactions", F.lit(0)).alias("total_transactions"),
            F.coalesce("total_revenue", F.lit(0)).cast("decimal(18,2)").alias("total_revenue"),
            F.coalesce("avg_foot_traffic", F.lit(0)).cast("decimal(14,4)").alias("avg_foot_traffic"),
        )
    )


def payment_usage(tables: RetailTables) -> DataFrame:
    """How often each payment method was used at each store, most used first."""
    return (
        tables.purchase.groupBy(*STORE, "payment_method")
        .agg(F.count("*").alias("usage_count"))
        .orderBy(*STORE, F.desc("usage_count"), "payment_method")
    )


def _category_spending(tables: RetailTables) -> DataFrame:
    """Sales after discount by customer and product category."""
    return (
        tables.purchase.join(tables.product, "product_id")
        .groupBy("customer_id", "product_category")
        .agg(total(_sale()).alias("sales"))
    )


def sales_by_category_age(tables: RetailTables) -> DataFrame:
    """Sales after discount by product category and age range of the buyer."""
    return (
        _category_spending(tables)
        .join(tables.customer, "customer_id")
        .groupBy("product_category", age_range(F.col("age")).alias("age_range"))
        .agg(F.sum("sales").cast("decimal(20,2)").alias("total_sales"))
    )


def sales_by_age(tables: RetailTables) -> DataFrame:
    """Sales after discount by age range, largest first."""
    return (
        sales_by_category_age(tables)
        .groupBy("age_range")
        .agg(F.sum("total_sales").cast("decimal(20,2)").alias("total_sales"))
        .orderBy(F.desc("total_sales"), "age_range")
    )


def category_age_span(tables: RetailTables) -> DataFrame:
    """First and last age range, in text order, that bought each category."""
    return (
        sales_by_category_age(tables)
        .groupBy("product_category")
        .agg(F.min("age_range").alias("youngest_buyers"), F.max("age_range").alias("oldest_buyers"))
    )


def needs_vs_wants(tables: RetailTables) -> DataFrame:
    """Spending on necessities and on everything else by age range."""
    needed = F.col("product_category").isin(NECESSITIES)

    def spent(condition: Column, name: str) -> Column:
        amount = F.when(condition, F.col("total_sales")).otherwise(F.lit(0))
        return F.round(F.sum(amount).cast("decimal(20,2)"), 2).cast("decimal(20,2)").alias(name)

    return (
        sales_by_category_age(tables)
        .groupBy("age_range")
        .agg(spent(needed, "necessities"), spent(~needed, "non_necessities"))
        .orderBy("age_range")
    )


def gender_stats(tables: RetailTables) -> DataFrame:
    """Purchases and average price before discount by gender."""
    per_customer = tables.purchase.groupBy("customer_id").agg(
        F.count("purchase_id").alias("purchases"),
        F.count(PRICE).alias("prices"),
        total(F.col(PRICE)).alias("spent"),
    )
    average = exact_average(whole_units(F.sum("spent"), 2), F.sum("prices"), 2)
    return (
        per_customer.join(tables.customer, "customer_id")
        .groupBy("gender")
        .agg(
            F.sum("purchases").alias("total_purchases"),
            average.cast("decimal(18,2)").alias("avg_spent_per_transaction"),
        )
    )


def gender_by_category(tables: RetailTables, category: str, collation: str | None = None) -> DataFrame:
    """Purchases of one product category by gender of the buyer."""
    wanted = tables.product.filter(same_text(F.col("product_category"), F.lit(category), collation))
    per_customer = (
        tables.purchase.join(wanted.select("product_id"), "product_id")
        .groupBy("customer_id")
        .agg(F.count("*").alias("purchases"))
    )
    return (
        per_customer.join(tables.customer, "customer_id")
        .groupBy("gender")
        .agg(F.sum("purchases").alias("purchase_count"))
    )


def top_chain_by_age_group(tables: RetailTables) -> DataFrame:
    """The chain with most visits in each age group; ties are kept.

    A visit counts once for each location of its chain. Visits are counted by store id
    first and multiplied by the number of locations, so the fan-out is never built.
    """
    visits = (
        tables.customer_visits.join(tables.customer, "customer_id")
        .groupBy(age_group(F.col("age")).alias("age_group"), "store_id")
        .agg(F.count("*").alias("visits"))
    )
    locations = tables.store.groupBy("store_id", F.col("store_chain_name").alias("store_chain")).agg(
        F.count("*").alias("locations")
    )
    best_first = Window.partitionBy("age_group").orderBy(F.desc("total_purchases"))
    return (
        visits.join(locations, "store_id")
        .select("age_group", "store_chain", (F.col("visits") * F.col("locations")).alias("total_purchases"))
        .withColumn("place", F.rank().over(best_first))
        .filter("place = 1")
        .drop("place")
        .orderBy("age_group", "store_chain")
    )


def top_inventory(tables: RetailTables, count: int = 10) -> DataFrame:
    """The most expensive items over all stores."""
    return (
        tables.inventory.join(tables.store.select(*STORE, "store_chain_name"), STORE)
        .orderBy(F.desc("product_price_usd"), *ITEM)
        .limit(count)
        .select("product_id", "store_chain_name", "store_location", "product_price_usd")
    )


def store_sales_stats(tables: RetailTables) -> DataFrame:
    """Total, count, average discount and price range of the sales of each store id."""
    return statistics.finish(statistics.parts(tables.purchase))


def _sold_items(tables: RetailTables) -> DataFrame:
    """Sales by stocked item: the only shuffle of the fact, on the inventory key."""
    return tables.purchase.groupBy(*ITEM).agg(
        F.count("purchase_id").alias("sold"),
        F.count(PRICE).alias("priced"),
        total(F.col(PRICE)).alias("list_total"),
        total(_sale()).alias("sale_total"),
    )


def store_profit(tables: RetailTables) -> DataFrame:
    """Price before discount minus cost, by chain name and location."""
    costs = tables.inventory.select(*ITEM, "product_cost_usd")
    per_store = (
        _sold_items(tables)
        .join(costs, ITEM)
        .groupBy(*STORE)
        .agg(F.sum(F.col("list_total") - F.col("product_cost_usd") * F.col("priced")).alias("profit"))
    )
    return (
        per_store.join(tables.store.select(*STORE, "store_chain_name"), STORE)
        .groupBy("store_chain_name", "store_location")
        .agg(F.sum("profit").cast("decimal(20,2)").alias("total_profit"))
    )


def store_scores(tables: RetailTables) -> DataFrame:
    """Half the conversion rate plus half the average profit of every store id.

    0 without transactions; NULL when traffic is missing or zero, or no sale is stocked.
    """
    costs = tables.inventory.select(*ITEM, "product_cost_usd")
    stocked = F.col("product_cost_usd").isNotNull()
    margin = F.col("sale_total") - F.col("product_cost_usd") * F.col("priced")
    sales = (
        _sold_items(tables)
        .join(costs, ITEM, "left")
        .groupBy("store_id")
        .agg(
            F.sum("sold").alias("transactions"),
            F.sum(F.when(stocked, margin)).cast("decimal(20,2)").alias("profit"),
        )
    )
    traffic = tables.popularity.groupBy("store_id").agg(F.sum("foot_traffic").alias("traffic"))
    conversion = F.try_divide(F.col("transactions").cast("double"), F.col("traffic").cast("double"))
    average_profit = F.try_divide(F.col("profit").cast("double"), F.col("transactions").cast("double"))
    score = F.lit(0.5) * conversion + F.lit(0.5) * average_profit
    no_sales = F.coalesce("transactions", F.lit(0)) == 0
    return (
        tables.store.select("store_id")
        .distinct()
        .join(sales, "store_id", "left")
        .join(traffic, "store_id", "left")
        .select("store_id", F.when(no_sales, F.lit(0.0)).otherwise(score).alias("score"))
    )


def chain_directory(tables: RetailTables) -> DataFrame:
    """Chain name and number of stores of each store id."""
    return tables.store.groupBy("store_id").agg(
        F.min_by("store_chain_name", "store_location").alias("store_chain_name"),
        F.count("*").alias("store_count"),
    )


def store_counts(tables: RetailTables, wanted: DataFrame) -> DataFrame:
    """Number of stores for each wanted ``store_id``; 0 for an unknown one."""
    counts = tables.store.groupBy("store_id").agg(F.count("*").alias("store_count"))
    return wanted.join(counts, "store_id", "left").fillna(0, ["store_count"])


def next_ids(tables: RetailTables) -> DataFrame:
    """The next free numeric purchase id (1 when there are none) and the largest buyer id."""
    return tables.purchase.agg(
        F.coalesce(F.max(as_number(F.col("purchase_id"))) + 1, F.lit(1).cast("bigint")).alias("next_purchase_id"),
        F.max("customer_id").alias("max_customer_id"),
    )


def purchasable_items(tables: RetailTables) -> DataFrame:
    """Item and store of every past purchase; repeats stay."""
    return tables.purchase.select(*ITEM)


def sale_prices(tables: RetailTables) -> DataFrame:
    """Price after discount of every purchase."""
    return tables.purchase.select("purchase_id", _sale().alias("sale_price"))


def contact_emails(tables: RetailTables) -> DataFrame:
    return tables.user_info.select("username", contact_email(F.col("username")).alias("email"))


def known_keys(wanted: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose key columns exist in ``table``."""
    return wanted.join(table, columns, "left_semi")

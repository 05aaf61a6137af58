"""The driver's order tables seen as retail tables.

Suppliers are stores, parts are products, order lines are purchases, events are foot
traffic. Every table is derived with joins and aggregates from the given parquet files.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise import schema, session
from tillwise.functions.digests import digest_bytes, salt, salted_digest
from tillwise.sources import staging
from tillwise.sources.tables import RetailTables, read_tables, write_table

STORE = ["store_id", "store_location"]
# Fixed values of the mapping.
CATEGORIES = {
    "STANDARD": "Clothing",
    "PROMO": "Groceries",
    "ECONOMY": "Health & Beauty",
    "MEDIUM": "Home & Kitchen",
    "SMALL": "Books",
}
OTHER_CATEGORY = "Electronics"
PAYMENTS = {0: "Cash", 1: "Credit Card", 2: "Debit Card"}
OTHER_PAYMENT = "Mobile Payment"
SALT_KEY = "sample"


def _choose(value: Column, choices: dict, other: str) -> Column:
    pairs = [F.lit(item) for pair in choices.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(other))


# Tables written once per application, by folder and the state of its files.
_loaded: dict[tuple, RetailTables | DataFrame] = {}
# Several tables are made from the order lines at a time.
_lines_lock = threading.Lock()

# An order line's number leaves room for so many lines with one order and line number, or the next
# power of ten that holds the most of them.
REPEATS = 1000
LINE_ORDER = [
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]


class SourceTables:
    """The given parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lines(self) -> DataFrame:
        """All order lines with their order, store and number, joined and stored once."""
        key = ("lines", self.spark.sparkContext.applicationId, self.folder, session.listing(self.spark, self.folder))
        with _lines_lock:
            if key not in _loaded:
                with session.freed_shuffles(self.spark):
                    lines = session.stored(_lines(self), "order-lines")
                _loaded[key] = _numbered(lines, lines.agg(F.max("place")).first()[0] or 1)
        return _loaded[key]


def _add_store(rows: DataFrame, source: SourceTables, supplier_key: str) -> DataFrame:
    """``rows`` with the store of a supplier key.

    Supplier and nation are joined to the rows as files, whose sizes Catalyst knows; a
    derived store table would hide them and shuffle the rows.
    """
    key = F.col(supplier_key)
    store_id = F.floor(key / 5).cast("bigint")
    suppliers = source("supplier").select(F.col("s_suppkey").alias("store_key"), "s_nationkey")
    return (
        rows.join(suppliers, key == F.col("store_key"))
        .join(source("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumns(
            {
                "store_id": store_id,
                "store_location": F.concat("n_name", F.lit("-"), (key % 5).cast("string")),
                "store_chain_name": F.concat(F.lit("Chain "), (store_id % 15).cast("string")),
                "year_opened": (key % 30 + 1990).cast("int"),
            }
        )
    )


def _lines(source: SourceTables) -> DataFrame:
    """Every order line with its order, store and ``place`` among lines that share order and line number.

    Lines that agree in all columns are interchangeable, so the place does not depend on
    the order in which they are read. The lines are shuffled once, by order: the window on
    order and line number and the join with the orders both keep to that partitioning.
    """
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER))
    by_order = source("lineitem").filter(F.col("l_orderkey").isNotNull()).repartition("l_orderkey")
    placed = by_order.withColumn("place", place)
    orders = source("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    ordered = placed.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return _add_store(ordered, source, "l_suppkey").select(
        "l_orderkey", "l_linenumber", *LINE_ORDER, "place", "o_custkey", "o_orderdate", "store_id", "store_location"
    )


def _numbered(lines: DataFrame, most: int) -> DataFrame:
    """Lines with ``line_no``: order, line number and place, of which there are ``most`` at most."""
    room = max(REPEATS, 10 ** len(str(most - 1)))
    return lines.withColumns(
        {
            "line_no": (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * room + F.col("place") - 1,
            "line_room": F.lit(room).cast("bigint"),
        }
    ).drop("place")


def _store(source: SourceTables) -> DataFrame:
    return _add_store(source("supplier").select("s_suppkey"), source, "s_suppkey")


def _product(source: SourceTables) -> DataFrame:
    return source("part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        _choose(F.col("p_type"), CATEGORIES, OTHER_CATEGORY).alias("product_category"),
    )


def _customer(source: SourceTables) -> DataFrame:
    key = F.col("c_custkey")
    return source("customer").select(
        key.cast("bigint").alias("customer_id"),
        (key % 100).cast("int").alias("age"),
        F.when(key % 3 == 0, "M").when(key % 3 == 1, "F").otherwise("X").alias("gender"),
        (F.abs("c_acctbal") * 10).cast("decimal(8,2)").alias("annual_income_usd"),
        F.col("c_name").alias("full_name"),
    )


def _purchase(source: SourceTables) -> DataFrame:
    return source.lines().select(
        F.col("line_no").cast("string").alias("purchase_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        "store_id",
        F.col("o_custkey").cast("bigint").alias("customer_id"),
        _choose(F.col("l_linenumber") % 4, PAYMENTS, OTHER_PAYMENT).alias("payment_method"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount_percent"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        "store_location",
        (F.col("l_extendedprice") / 11).cast("decimal(6,2)").alias("purchased_product_price_usd"),
    )


def _inventory(source: SourceTables) -> DataFrame:
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    items = source.lines().select("l_partkey", "l_suppkey", "store_id", "store_location").distinct()
    return items.join(source("part"), part == F.col("p_partkey")).select(
        part.cast("string").alias("product_id"),
        "store_id",
        "store_location",
        ((part + supplier) % 3).cast("int").alias("qty"),
        (F.col("p_retailprice") + supplier % 13).cast("decimal(8,2)").alias("product_price_usd"),
        (F.col("p_retailprice") * 0.6).cast("decimal(6,2)").alias("product_cost_usd"),
        F.when(part % 5 != 0, (F.col("p_retailprice") + 5).cast("decimal(8,2)")).alias("competitor_price_usd"),
    )


def _popularity(source: SourceTables) -> DataFrame:
    store_total = source("supplier").agg(F.count("*")).scalar()
    visits = (
        source("events")
        .groupBy((F.col("user_id") % store_total).alias("visited"), F.col("ts").cast("date").alias("visit_date"))
        .agg(F.count("*").cast("int").alias("foot_traffic"))
    )
    return _add_store(visits, source, "visited").select("store_id", "store_location", "visit_date", "foot_traffic")


def _customer_visits(source: SourceTables) -> DataFrame:
    pairs = source.lines().select("o_custkey", "l_suppkey", "store_id", "store_location").distinct()
    return pairs.select(
        F.col("o_custkey").cast("bigint").alias("customer_id"),
        "store_id",
        "store_location",
        ((F.col("o_custkey") + F.col("l_suppkey")) % 4 == 0).alias("is_favorite"),
    )


# What is wrong with some candidates.
OVERLONG = "9" * 25


def purchase_candidates(source: SourceTables) -> DataFrame:
    """Every order line as a purchase entered by hand: text columns, many rules broken.

    Lines with odd numbers come with ids already taken, others with new ids, two lines to
    an id where lines share order and line number. Some orders have overlong ids.
    """
    order, repeat = F.col("l_orderkey") % 50, F.col("line_no") % F.col("line_room")
    first = F.col("line_no") - repeat
    new = F.when(F.col("l_linenumber") % 2 == 0, first + F.floor(F.col("line_room") / 2) + F.floor(repeat / 2)).otherwise(first)

    def unless(broken: int, value: Column) -> Column:
        return F.when(order == broken, F.lit(OVERLONG)).otherwise(value.cast("bigint").cast("string"))

    return source.lines().select(
        unless(3, new).alias("purchase_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        unless(2, F.col("store_id")).alias("store_id"),
        unless(1, F.col("o_custkey")).alias("customer_id"),
        _choose(F.col("l_linenumber") % 4, PAYMENTS, OTHER_PAYMENT).alias("payment_method"),
        (F.col("l_quantity") * 3).cast("int").cast("string").alias("discount_percent"),
        F.col("l_shipdate").cast("date").cast("string").alias("txn_date"),
        "store_location",
        F.floor(F.col("l_extendedprice") / 7).cast("bigint").cast("string").alias("purchased_product_price_usd"),
    )


def raw_purchases(source: SourceTables) -> DataFrame:
    """Order lines with a key that repeats and their full price, for the key and domain audits."""
    return source.lines().select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("purchase_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        "store_id",
        "store_location",
        F.round(F.col("l_discount") * 100).cast("int").alias("discount_percent"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("purchased_product_price_usd"),
    )


def stock_changes(source: SourceTables) -> DataFrame:
    """Order lines as stock changes: returned lines add their quantity, others take it."""
    quantity = F.col("l_quantity").cast("bigint")
    return source.lines().select(
        F.col("l_partkey").cast("string").alias("product_id"),
        "store_id",
        "store_location",
        F.col("l_shipdate").cast("date").alias("change_day"),
        F.col("line_no").alias("change_number"),
        F.when(F.col("l_returnflag") == "R", quantity).otherwise(-quantity).alias("qty_change"),
    )


# A store with more purchases than this is joined by item and customer.
HOT_STORE = 1_000_000


def flat_rows(tables: RetailTables, hot_store: int = HOT_STORE) -> DataFrame:
    """Purchases with all attributes beside them, as in a flat sales file.

    A row carries the days of foot traffic whose day of month is the purchase number modulo
    31, where its store has such days; days without a purchase have rows of their own.

    Stock, visits and traffic of a purchase belong to its store, so the purchases are shuffled once,
    by store, for all three joins (under :func:`_kept_partitions`). Stores with more than
    ``hot_store`` purchases are joined by the whole keys instead, which spread over many tasks.
    """
    purchase, popularity = tables.purchase, tables.popularity
    sizes = purchase.groupBy(*STORE).agg(F.count("*").alias("n"))
    hot = session.stored(sizes.filter(F.col("n") > hot_store).select(*STORE), "hot-stores")
    if hot.isEmpty():
        return _flat(tables, purchase, popularity, True)
    others = _flat(tables, purchase.join(hot, STORE, "left_anti"), popularity.join(hot, STORE, "left_anti"), True)
    return others.unionByName(
        _flat(tables, purchase.join(hot, STORE, "left_semi"), popularity.join(hot, STORE, "left_semi"), False)
    )


# Tables with the key of a store, and purchases of which the flat rows are made at a time.
OF_STORES = ["purchase", "inventory", "customer_visits", "popularity"]
SHARE_ROWS = 32_000_000


def store_shares(tables: RetailTables, share_rows: int = SHARE_ROWS) -> Iterator[RetailTables]:
    """The tables cut by store into shares of some ``share_rows`` purchases.

    Stock, visits and traffic are joined by store, so the flat rows of all shares are those of the
    whole tables, and the files that one share shuffles can go before the next one is made.
    """
    shares = max(1, -(-tables.purchase.count() // share_rows))
    share = F.pmod(F.xxhash64(F.col("store_id").cast("bigint"), F.col("store_location")), F.lit(shares))
    for k in range(shares):
        yield tables if shares == 1 else tables.replacing(**{name: tables[name].filter(share == k) for name in OF_STORES})


def _flat(tables: RetailTables, purchase: DataFrame, popularity: DataFrame, by_store: bool) -> DataFrame:
    """Flat rows of some stores: their purchases and traffic, dealt by store or by the whole keys."""

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*STORE) if by_store else rows

    day = F.dayofmonth("visit_date").alias("visit_day")
    traffic = popularity.select(*STORE, "visit_date", "foot_traffic", day)
    purchases = purchase.withColumn("visit_day", (F.col("purchase_id").cast("bigint") % 31).cast("int"))
    joined = (
        dealt(purchases.join(tables.product, "product_id").join(tables.customer, "customer_id"))
        .join(dealt(tables.inventory), ["product_id", *STORE], "left")
        .join(dealt(tables.customer_visits), ["customer_id", *STORE], "left")
        .join(dealt(traffic), [*STORE, "visit_day"], "full")
        .join(tables.store, STORE)
        .withColumn("purchase_date", F.col("txn_date"))
        .withColumn("is_favorite", F.col("is_favorite").cast("int"))
    )
    return joined.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.STAGING.fields])


def _kept_partitions(spark: SparkSession):
    """Rows that are dealt by a part of a join's key stay where they are."""
    return session.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def user_requests(source: SourceTables) -> DataFrame:
    """One sign-up request per customer; every tenth is an administrator."""
    key = F.col("c_custkey")
    admin = key % 10 == 0
    return source("customer").select(
        key.alias("arrival"),
        F.concat(F.lit("user_"), key.cast("string")).alias("username"),
        F.concat(F.lit("secret_"), (key % 97).cast("string")).alias("secret"),
        admin.cast("int").alias("is_admin"),
        F.col("c_mktsegment").alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.when(~admin, (key % 2).cast("int")).alias("is_store_manager"),
        F.when(~admin, F.concat(F.lit("555-"), key.cast("string"))).alias("phone_number"),
        F.when(admin, F.when(key % 20 == 0, "engineer").otherwise("researcher")).alias("employee_type"),
    )


def _user_info(source: SourceTables) -> DataFrame:
    salted = user_requests(source).withColumn("salt", salt(F.col("username"), SALT_KEY))
    return salted.select(
        "username",
        "first_name",
        "last_name",
        "salt",
        digest_bytes(salted_digest(F.col("salt"), F.col("secret"))).alias("password_hash"),
        "is_admin",
    )


def _client(source: SourceTables) -> DataFrame:
    return (
        user_requests(source).filter("is_admin = 0").select("username", "is_store_manager", "phone_number")
    )


def _admin(source: SourceTables) -> DataFrame:
    return user_requests(source).filter("is_admin = 1").select("username", "employee_type")


def repeated_requests(source: SourceTables) -> DataFrame:
    """Sign-up requests whose names repeat: one name per market segment and nation."""
    name = F.lower(F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")))
    named = source("customer").select(F.col("c_custkey").alias("arrival"), name.alias("chosen_name"))
    return user_requests(source).join(named, "arrival").withColumn("username", F.col("chosen_name")).drop("chosen_name")


def names_in_debt(source: SourceTables) -> DataFrame:
    """Names of :func:`repeated_requests` with a customer below zero balance."""
    name = F.lower(F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return source("customer").filter("c_acctbal < 0").select(name.alias("username")).distinct()


def faulty_requests(source: SourceTables) -> DataFrame:
    """Sign-up requests that break one rule or another, depending on the customer."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    text = key.cast("string")
    phone = F.when(nation < 8, F.concat(F.lit("+1 (555) "), text)).when(nation < 16, F.concat(F.lit("tel "), text))
    return source("customer").select(
        F.when(key % 3 == 0, F.col("c_name"))
        .when(key % 3 == 1, F.concat(F.lit("user_"), text))
        .when(nation < 12, F.concat(F.lit("new user "), text))
        .otherwise(F.concat(F.lit("new_"), text))
        .alias("username"),
        F.when(nation == 3, F.lit("")).otherwise(F.col("c_mktsegment")).alias("secret"),
        (key % 10 == 0).cast("int").alias("is_admin"),
        F.when(nation != 5, F.col("c_mktsegment")).alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.when(nation != 7, (key % 2).cast("int")).alias("is_store_manager"),
        phone.otherwise(F.concat(F.lit("555-555-555-555-"), text)).alias("phone_number"),
        F.when(key % 20 == 0, "Engineer").otherwise("visitor").alias("employee_type"),
    )


def digest_attempts(source: SourceTables) -> DataFrame:
    """Logins with a secret that is right for some users; every seventh name is unknown."""
    key = F.col("c_custkey")
    return source("customer").select(
        F.concat(F.when(key % 7 == 0, "guest_").otherwise("user_"), key.cast("string")).alias("username"),
        F.concat(F.lit("secret_"), (key % 89).cast("string")).alias("secret"),
    )


def digest_changes(source: SourceTables) -> DataFrame:
    """New secrets by order: the latest order of a customer gives the secret."""
    return source("orders").select(
        F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("username"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("secret"),
        F.col("o_orderkey").alias("arrival"),
    )


BUILDERS = {
    "store": _store,
    "product": _product,
    "customer": _customer,
    "purchase": _purchase,
    "inventory": _inventory,
    "popularity": _popularity,
    "customer_visits": _customer_visits,
    "user_info": _user_info,
    "client": _client,
    "admin": _admin,
}


def mapped_tables(spark: SparkSession, folder: str) -> RetailTables:
    """The mapping as lazy plans over the given files."""
    source = SourceTables(spark, folder)
    return RetailTables({name: _plan(build, source, name) for name, build in BUILDERS.items()})


def _plan(build, source: SourceTables, name: str):
    return lambda: schema.conform(build(source), name)


def load_tables(spark: SparkSession, folder: str) -> RetailTables:
    """The mapped tables, each written once per application to the shared folder.

    Reports then scan narrow, typed parquet with known sizes instead of repeating the
    normalisation.
    """
    key = (spark.sparkContext.applicationId, folder, session.listing(spark, folder))
    if key not in _loaded:
        _loaded[key] = _written_on_use(spark, mapped_tables(spark, folder))
    return _loaded[key]


def _written_on_use(spark: SparkSession, tables: RetailTables) -> RetailTables:
    target = session.new_folder(spark, "tables")
    stored = read_tables(spark, target, tables.names())
    written: dict[str, DataFrame] = {}

    def write_then_read(name: str):
        def build() -> DataFrame:
            # Sets made from this one build their tables here as well.
            if name not in written:
                write_table(tables[name], target, name)
                written[name] = stored[name]
            return written[name]

        return build

    return RetailTables({name: write_then_read(name) for name in tables.names()})


def load_all(spark: SparkSession, folder: str, at_once: int = 4) -> RetailTables:
    """All mapped tables, several written at a time: their jobs do not depend on each other."""
    tables = load_tables(spark, folder)
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(tables.__getitem__, tables.names()))
    return tables


def load_staging(spark: SparkSession, folder: str, mysql_coerce: bool = False) -> DataFrame:
    """The flat file made from the mapped tables, written, read back and stored typed, once.

    It is made in shares of the stores; a share's text goes once it is stored typed.
    """
    key = ("staging", mysql_coerce, spark.sparkContext.applicationId, folder, session.listing(spark, folder))
    if key not in _loaded:
        target = session.new_folder(spark, "staging")
        with _kept_partitions(spark), session.freed_shuffles(spark):
            for k, share in enumerate(store_shares(load_tables(spark, folder))):
                staging.write_flat(flat_rows(share), f"{target}/csv/{k}", "gzip")
                read = staging.read_staging(spark, f"{target}/csv/{k}", mysql_coerce=mysql_coerce)
                typed = staging.store_staging(read, f"{target}/typed/{k}")
                session.remove(spark, f"{target}/csv/{k}")
        _loaded[key] = spark.read.schema(typed.schema).parquet(f"{target}/typed/*")
    return _loaded[key]

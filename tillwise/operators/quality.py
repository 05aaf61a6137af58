"""Constraints and input rules as set-based audits.

Every audit returns the violating rows with a ``reasons`` array, so that a load can
quarantine them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise import schema, session
from tillwise.functions.text import as_number, is_digits, is_phone, is_word, strict_date
from tillwise.sources.tables import RetailTables

REASONS = "reasons"

# Limits of the purchase rules.
ID_DIGITS = 7
PRICE_LIMIT = 100_000
MAX_DISCOUNT = 100
PHONE_WIDTH = 20
# Candidates that are checked at a time.
SHARE_ROWS = 64_000_000


def with_reasons(df: DataFrame, rules: Iterable[tuple[str, Column]]) -> DataFrame:
    """Add the names of the rules each row breaks, in rule order."""
    broken = [F.when(condition, F.lit(reason)) for reason, condition in rules]
    return df.withColumn(REASONS, F.array_compact(F.array(*broken)))


def violations(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(REASONS) > 0)


def passing(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(REASONS) == 0)


def report(found: DataFrame, table: str) -> DataFrame:
    """Violations of any table in one layout: table, key text, one row per reason."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in schema.KEYS[table]])
    return found.select(F.lit(table).alias("table_name"), key.alias("row_key"), F.explode(REASONS).alias("reason"))


def null_audit(df: DataFrame, table: str) -> DataFrame:
    """Rows with NULL in a required column."""
    required = [field.name for field in schema.TABLES[table].fields if not field.nullable]
    return violations(with_reasons(df, [(f"{name} is missing", F.col(name).isNull()) for name in required]))


def key_conflicts(df: DataFrame, key: list[str]) -> DataFrame:
    """Distinct rows that share a key with a different row.

    A key has different rows if the smallest and the largest of its rows differ, which
    combines on the map side; only rows of such keys are compared in full.
    """
    rest = F.struct(*[c for c in df.columns if c not in key])
    bounds = df.groupBy(*key).agg(F.min(rest).alias("least"), F.max(rest).alias("most"))
    shared = bounds.filter(F.col("least") != F.col("most")).select(*key)
    return df.join(shared, key, "left_semi").distinct()


def orphans(child: DataFrame, references: Iterable[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Rows whose reference finds no parent; a reference with a NULL part is not checked.

    ``references`` are (name, parent, columns). The child is scanned once and stays the
    left side of every join, which AQE can split on a skewed key.
    """
    checked, rules = child, []
    for i, (name, parent, columns) in enumerate(references):
        found = f"found_{i}"
        keys = parent.select(*columns).distinct().withColumn(found, F.lit(True))
        checked = checked.join(keys, columns, "left")
        complete = _all(F.col(c).isNotNull() for c in columns)
        rules.append((f"no {name}", complete & F.col(found).isNull()))
    return violations(with_reasons(checked, rules)).select(*child.columns, REASONS)


def table_orphans(tables: RetailTables, child: str) -> DataFrame:
    """Orphans of the declared references of one table."""
    declared = [ref for ref in schema.REFERENCES if ref.child == child]
    return orphans(tables[child], [(ref.parent, tables[ref.parent], list(ref.columns)) for ref in declared])


def _all(conditions: Iterable[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def domain_audit(df: DataFrame, table: str) -> DataFrame:
    """Rows outside the declared value lists, ranges, text widths or decimal ranges."""
    return violations(with_reasons(df, _domain_rules(df, table)))


def _domain_rules(df: DataFrame, table: str) -> list[tuple[str, Column]]:
    rules = [
        (f"{name} is longer than {width}", F.length(name) > width)
        for name, width in schema.TEXT_WIDTHS.get(table, {}).items()
        if name in df.columns
    ]
    for field in schema.TABLES.get(table, T.StructType()).fields:
        if isinstance(field.dataType, T.DecimalType) and field.name in df.columns:
            column = F.col(field.name)
            does_not_fit = column.isNotNull() & column.try_cast(field.dataType).isNull()
            rules.append((f"{field.name} does not fit {field.dataType.simpleString()}", does_not_fit))
    listed = {
        "customer": [
            ("gender is not listed", ~F.col("gender").isin(schema.GENDERS)),
            ("age is out of range", ~F.col("age").between(*schema.AGE_RANGE)),
        ],
        "store": [("year_opened is out of range", ~F.col("year_opened").between(*schema.YEAR_RANGE))],
        "admin": [("employee_type is not listed", ~F.col("employee_type").isin(schema.EMPLOYEE_TYPES))],
    }
    return rules + listed.get(table, [])


def _number_rules(name: str, above: tuple[str, int] | None = None) -> list[tuple[str, Column]]:
    text = F.trim(name)
    digits = F.coalesce(is_digits(text), F.lit(False))
    rules = [(f"{name} is not a number", ~digits)]
    if above is not None:
        reason, limit = above
        rules.append((reason, digits & (F.coalesce(as_number(text), F.lit(limit)) >= limit)))
    return rules


def check_purchases(
    candidates: DataFrame,
    tables: RetailTables,
    as_of: Column | None = None,
    id_digits: int = ID_DIGITS,
    taken: Callable[[DataFrame], DataFrame] | None = None,
    share_rows: int = SHARE_ROWS,
) -> DataFrame:
    """Candidate purchases, all columns as entered text, with the rules each breaks.

    ``as_of`` is the last valid transaction date, today by default; ``id_digits`` the width
    of purchase and product ids. ``taken`` returns which of the numbers it is given (``number``) are
    ids of purchases, by an index; without it the ids of all purchases are read. Rows that break no rule on their own are then compared with
    each other: identical copies count once, and different rows with one id are all refused,
    as a batch has no arrival order. The result of the first step is read three times, so
    it is stored.
    """
    today = F.current_date() if as_of is None else as_of
    with session.freed_shuffles(candidates.sparkSession):
        checked = _check_in_shares(candidates, tables, today, id_digits, taken, share_rows)
    unique = passing(checked).distinct().withColumn("purchase_no", as_number(F.trim("purchase_id")))
    repeated = unique.groupBy("purchase_no").agg((F.count("*") > 1).alias("is_repeated"))
    compared = unique.join(repeated, "purchase_no").withColumn(
        REASONS, F.when(F.col("is_repeated"), F.array(F.lit("purchase_id is repeated"))).otherwise(F.col(REASONS))
    )
    return violations(checked).unionByName(compared.select(*checked.columns))


def _check_in_shares(
    candidates: DataFrame,
    tables: RetailTables,
    today: Column,
    id_digits: int,
    taken: Callable[[DataFrame], DataFrame] | None,
    share_rows: int,
) -> DataFrame:
    """Candidates with the rules that each breaks on its own, stored in shares of some ``share_rows``.

    What one share shuffles can go before the next one is checked. The shares are a power of two and are
    dealt by the hash that :class:`TakenIds` deals its parts by, so that each share asks for parts of its own.
    """
    spark = candidates.sparkSession
    folder = session.new_folder(spark, "checked-purchases")
    with session.cleared(spark, "entered-purchases", "wanted-ids", "passed-ids"):
        entered = session.stored(candidates, "entered-purchases")
        shares = 1 << (max(1, -(-entered.count() // share_rows)) - 1).bit_length()
        number = as_number(F.trim("purchase_id"))
        share_of = F.when(number.isNull(), F.xxhash64(*entered.columns)).otherwise(F.xxhash64(number))
        for k in range(shares):
            some, history = entered, tables
            if shares > 1:
                some = entered.filter(F.pmod(share_of, F.lit(shares)) == k)
                of_share = F.pmod(F.xxhash64(as_number(F.col("purchase_id"))), F.lit(shares)) == k
                history = tables.replacing(purchase=lambda: tables.purchase.filter(of_share))
            checked = _check_each_purchase(some, history, today, id_digits, taken, is_stored=True)
            checked.write.parquet(f"{folder}/{k}")
    return spark.read.schema(checked.schema).parquet(f"{folder}/*")


def _check_each_purchase(
    candidates: DataFrame,
    tables: RetailTables,
    today: Column,
    id_digits: int,
    taken: Callable[[DataFrame], DataFrame] | None = None,
    is_stored: bool = False,
) -> DataFrame:
    """Each table of known keys is first reduced to the keys the candidates name.

    The candidates are stored, so Catalyst knows their size: a small batch is broadcast to
    the history of all purchases, which is then not shuffled at all.
    """
    numbers = {name: as_number(F.trim(name)) for name in ("purchase_id", "customer_id", "store_id", "product_id")}
    keys_of = {
        "purchase_no": numbers["purchase_id"],
        "customer_no": numbers["customer_id"],
        "store_no": numbers["store_id"],
        "product_no": numbers["product_id"],
        "location": F.trim("store_location"),
    }
    entered = candidates if is_stored else session.stored(candidates, "entered-purchases")

    def entered_keys(names: list[str]) -> DataFrame:
        return entered.select(*[keys_of[name].alias(name) for name in names])

    store_no = F.col("store_id").cast("bigint").alias("store_no")
    stores = tables.store.select(store_no, F.col("store_location").alias("known_location"))
    if taken is None:
        ids = tables.purchase.select(as_number(F.col("purchase_id")).alias("purchase_no"))
    else:
        ids = taken(entered_keys(["purchase_no"]).withColumnRenamed("purchase_no", "number"))
        ids = ids.select(F.col("number").alias("purchase_no"))
    known = {
        "is_taken": ids,
        "is_customer": tables.customer.select(F.col("customer_id").cast("bigint").alias("customer_no")),
        "is_stocked": tables.inventory.select(
            as_number(F.col("product_id")).alias("product_no"), store_no, F.col("store_location").alias("location")
        ),
    }
    # The rows carry the keys of one join at a time: those of the others are read from the text again.
    rows = entered
    for flag, keys in known.items():
        names = keys.columns
        flagged = _named_by(entered_keys(names), keys, names).distinct().withColumn(flag, F.lit(True))
        rows = rows.withColumns({name: keys_of[name] for name in names}).join(flagged, names, "left").drop(*names)
    locations = (
        _named_by(entered_keys(["store_no"]), stores, ["store_no"])
        .groupBy("store_no")
        .agg(F.collect_set("known_location").alias("locations"))
    )
    rows = rows.withColumn("store_no", keys_of["store_no"]).join(locations, "store_no", "left")
    rows = rows.withColumns({"location": keys_of["location"], "entered_date": strict_date(F.trim("txn_date"))})

    price, payment = as_number(F.trim("purchased_product_price_usd")), F.trim("payment_method")
    is_located = F.coalesce(F.array_contains("locations", F.col("location")), F.lit(False))
    digits = {name: F.coalesce(is_digits(F.trim(name)), F.lit(False)) for name in ("customer_id", "store_id")}
    rules = [
        *_number_rules("purchase_id", (f"purchase_id has more than {id_digits} digits", 10**id_digits)),
        ("purchase_id is taken", F.col("is_taken").isNotNull()),
        *_number_rules("customer_id"),
        ("customer_id is unknown", digits["customer_id"] & F.col("is_customer").isNull()),
        *_number_rules("store_id"),
        ("store_id is unknown", digits["store_id"] & F.col("locations").isNull()),
        ("store_location is unknown", ~is_located),
        *_number_rules("product_id", (f"product_id has more than {id_digits} digits", 10**id_digits)),
        ("product_id is not sold there", F.col("is_stocked").isNull()),
        *_number_rules("purchased_product_price_usd", ("price is 100000 or more", PRICE_LIMIT)),
        ("price does not fit decimal(6,2)", (price < PRICE_LIMIT) & price.try_cast("decimal(6,2)").isNull()),
        *_number_rules("discount_percent", ("discount_percent is over 100", MAX_DISCOUNT + 1)),
        ("payment_method is not accepted", ~F.coalesce(payment.isin(schema.ACCEPTED_PAYMENTS), F.lit(False))),
        ("txn_date is not a date", F.col("entered_date").isNull()),
        ("txn_date is in the future", F.col("entered_date") > today),
    ]
    return with_reasons(rows, rules).select(*candidates.columns, REASONS)


def _named_by(entered: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The known keys that some candidate names."""
    return keys.join(entered.select(*on), on, "left_semi")


def accepted_purchases(checked: DataFrame) -> DataFrame:
    """Passing candidates as purchase rows."""
    trimmed = passing(checked).select(*[F.trim(c).alias(c) for c in checked.columns if c != REASONS])
    return schema.conform(trimmed.withColumn("txn_date", strict_date(F.col("txn_date"))), "purchase")


def check_users(requests: DataFrame, user_info: DataFrame) -> DataFrame:
    """Sign-up requests with the rules each breaks."""
    names = user_info.select("username").distinct().withColumn("is_taken", F.lit(True))
    admin = F.coalesce(F.col("is_admin") == 1, F.lit(False))
    employee_type = F.lower(F.coalesce("employee_type", F.lit("")))
    phone = F.coalesce(F.col("phone_number"), F.lit(""))
    manager = F.coalesce(F.col("is_store_manager").cast("string"), F.lit(""))
    rules = [
        *_word_rules("username"),
        ("username is taken", F.col("is_taken").isNotNull()),
        *_word_rules("secret"),
        ("first_name is missing", F.coalesce("first_name", F.lit("")) == ""),
        ("last_name is missing", F.coalesce("last_name", F.lit("")) == ""),
        ("employee_type is not listed", admin & ~employee_type.isin(schema.EMPLOYEE_TYPES)),
        ("is_store_manager is not 0 or 1", ~admin & ~manager.isin("0", "1")),
        ("phone_number is longer than 20", ~admin & (F.length(phone) > PHONE_WIDTH)),
        ("phone_number has other characters", ~admin & ~is_phone(phone)),
    ]
    return with_reasons(requests.join(names, "username", "left"), rules).select(*requests.columns, REASONS)


def _word_rules(name: str) -> list[tuple[str, Column]]:
    text = F.coalesce(F.col(name), F.lit(""))
    spaced = F.contains(text, F.lit(" "))
    return [
        (f"{name} is missing", text == ""),
        (f"{name} has a space", spaced),
        (f"{name} has other characters", (text != "") & ~spaced & ~is_word(text)),
    ]


def check_logins(attempts: DataFrame, user_info: DataFrame) -> DataFrame:
    """Login attempts with the rules each breaks; the name must exist."""
    names = user_info.select("username").distinct().withColumn("is_known", F.lit(True))
    rules = [
        *_word_rules("username"),
        ("username is unknown", F.col("is_known").isNull()),
        *_word_rules("secret"),
    ]
    return with_reasons(attempts.join(names, "username", "left"), rules).select(*attempts.columns, REASONS)

"""Declared schemas, keys and references of the retail tables.

Spark enforces none of the constraints on files, so they are data here and the audits
in ``tillwise.operators.quality`` check them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


REQUIRED, OPTIONAL = False, True
ID, INT, TEXT, DATE, FLOAT = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.FloatType()


def money(precision: int) -> T.DecimalType:
    return T.DecimalType(precision, 2)


# Table layouts, column types and nullability.
STAGING = _table(
    ("customer_id", ID, OPTIONAL),
    ("age", INT, OPTIONAL),
    ("annual_income_usd", FLOAT, OPTIONAL),
    ("product_category", TEXT, OPTIONAL),
    ("product_price_usd", FLOAT, OPTIONAL),
    ("purchase_date", DATE, OPTIONAL),
    ("store_id", ID, OPTIONAL),
    ("store_location", TEXT, OPTIONAL),
    ("payment_method", TEXT, OPTIONAL),
    ("discount_percent", INT, OPTIONAL),
    ("product_cost_usd", FLOAT, OPTIONAL),
    ("foot_traffic", INT, OPTIONAL),
    ("qty", INT, OPTIONAL),
    ("competitor_price_usd", FLOAT, OPTIONAL),
    ("full_name", TEXT, OPTIONAL),
    ("gender", TEXT, OPTIONAL),
    ("year_opened", INT, OPTIONAL),
    ("is_favorite", INT, OPTIONAL),
    ("purchase_id", TEXT, OPTIONAL),
    ("product_id", TEXT, OPTIONAL),
    ("visit_date", DATE, OPTIONAL),
    ("purchased_product_price_usd", money(6), OPTIONAL),
    ("store_chain_name", TEXT, OPTIONAL),
)

TABLES: dict[str, T.StructType] = {
    "customer": _table(
        ("customer_id", ID, REQUIRED),
        ("age", INT, REQUIRED),
        ("gender", TEXT, REQUIRED),
        ("annual_income_usd", money(8), REQUIRED),
        ("full_name", TEXT, REQUIRED),
    ),
    "store": _table(
        ("store_id", ID, REQUIRED),
        ("store_location", TEXT, REQUIRED),
        ("store_chain_name", TEXT, OPTIONAL),
        ("year_opened", INT, REQUIRED),
    ),
    "product": _table(
        ("product_id", TEXT, REQUIRED),
        ("product_category", TEXT, REQUIRED),
    ),
    "inventory": _table(
        ("product_id", TEXT, REQUIRED),
        ("store_id", ID, REQUIRED),
        ("store_location", TEXT, REQUIRED),
        ("qty", INT, REQUIRED),
        ("product_price_usd", money(8), REQUIRED),
        ("product_cost_usd", money(6), REQUIRED),
        ("competitor_price_usd", money(8), OPTIONAL),
    ),
    "popularity": _table(
        ("store_id", ID, REQUIRED),
        ("store_location", TEXT, REQUIRED),
        ("visit_date", DATE, REQUIRED),
        ("foot_traffic", INT, REQUIRED),
    ),
    "purchase": _table(
        ("purchase_id", TEXT, REQUIRED),
        ("product_id", TEXT, OPTIONAL),
        ("store_id", ID, OPTIONAL),
        ("customer_id", ID, OPTIONAL),
        ("payment_method", TEXT, REQUIRED),
        ("discount_percent", INT, REQUIRED),
        ("txn_date", DATE, REQUIRED),
        ("store_location", TEXT, OPTIONAL),
        ("purchased_product_price_usd", money(6), REQUIRED),
    ),
    "customer_visits": _table(
        ("customer_id", ID, REQUIRED),
        ("store_id", ID, REQUIRED),
        ("store_location", TEXT, REQUIRED),
        ("is_favorite", T.BooleanType(), REQUIRED),
    ),
    "user_info": _table(
        ("username", TEXT, REQUIRED),
        ("first_name", TEXT, REQUIRED),
        ("last_name", TEXT, REQUIRED),
        ("salt", TEXT, REQUIRED),
        ("password_hash", T.BinaryType(), REQUIRED),
        ("is_admin", INT, REQUIRED),
    ),
    "client": _table(
        ("username", TEXT, REQUIRED),
        ("is_store_manager", INT, REQUIRED),
        ("phone_number", TEXT, OPTIONAL),
    ),
    "admin": _table(
        ("username", TEXT, REQUIRED),
        ("employee_type", TEXT, REQUIRED),
    ),
    "mv_store_sales_stats": _table(
        ("store_id", ID, REQUIRED),
        ("total_sales", money(20), REQUIRED),
        ("num_purchases", ID, REQUIRED),
        ("avg_discount", money(5), REQUIRED),
        ("min_price", money(12), REQUIRED),
        ("max_price", money(12), REQUIRED),
    ),
}

KEYS: dict[str, list[str]] = {
    "customer": ["customer_id"],
    "store": ["store_id", "store_location"],
    "product": ["product_id"],
    "inventory": ["product_id", "store_id", "store_location"],
    "popularity": ["store_id", "store_location", "visit_date"],
    "purchase": ["purchase_id"],
    "customer_visits": ["customer_id", "store_id", "store_location"],
    "user_info": ["username"],
    "client": ["username"],
    "admin": ["username"],
    "mv_store_sales_stats": ["store_id"],
}


@dataclass(frozen=True)
class Reference:
    """``child.columns`` must be found in ``parent.columns`` (the parent's key)."""

    child: str
    parent: str
    columns: tuple[str, ...]


REFERENCES: list[Reference] = [
    Reference("inventory", "store", ("store_id", "store_location")),
    Reference("inventory", "product", ("product_id",)),
    Reference("popularity", "store", ("store_id", "store_location")),
    Reference("purchase", "product", ("product_id",)),
    Reference("purchase", "store", ("store_id", "store_location")),
    Reference("purchase", "customer", ("customer_id",)),
    Reference("customer_visits", "store", ("store_id", "store_location")),
    Reference("customer_visits", "customer", ("customer_id",)),
    Reference("client", "user_info", ("username",)),
    Reference("admin", "user_info", ("username",)),
]

# Declared text widths.
TEXT_WIDTHS: dict[str, dict[str, int]] = {
    "customer": {"gender": 1, "full_name": 255},
    "store": {"store_location": 255, "store_chain_name": 50},
    "product": {"product_id": 7, "product_category": 255},
    "inventory": {"product_id": 7, "store_location": 255},
    "popularity": {"store_location": 255},
    "purchase": {"purchase_id": 7, "product_id": 7, "payment_method": 255, "store_location": 255},
    "customer_visits": {"store_location": 255},
    "user_info": {"username": 20, "first_name": 50, "last_name": 50, "salt": 8},
    "client": {"username": 20, "phone_number": 20},
    "admin": {"username": 20},
}

# Text widths of the flat file.
STAGING_WIDTHS = {
    "product_category": 255,
    "store_location": 255,
    "payment_method": 255,
    "full_name": 255,
    "gender": 1,
    "purchase_id": 7,
    "product_id": 7,
    "store_chain_name": 50,
}

# Value lists and ranges of the declared rules.
GENDERS = ["M", "F", "X"]
AGE_RANGE = (0, 99)
EMPLOYEE_TYPES = ["researcher", "engineer", "maintenance"]
YEAR_RANGE = (1901, 2155)
DISCOUNT_RANGE = (0, 100)
ACCEPTED_PAYMENTS = ["Credit Card", "Debit Card", "Cash"]
NECESSITIES = ["Groceries", "Health & Beauty"]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the declared columns and types of ``table``."""
    return df.select(*[_as_declared(field) for field in TABLES[table].fields])


def _as_declared(field: T.StructField) -> Column:
    return F.col(field.name).cast(field.dataType).alias(field.name)

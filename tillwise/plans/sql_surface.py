"""The retail tables as SQL: temporary views and SQL functions.

After :func:`register` the session answers queries such as
``SELECT store_id, store_score(store_id) FROM store`` and ``SELECT store_count(25)``.
Every function is a SQL expression that Catalyst inlines and decorrelates, so applying one
to a column is a join, not a lookup per row.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from tillwise.functions.text import MAIL_DOMAIN
from tillwise.plans import reports
from tillwise.sources.tables import RetailTables

# Views of derived results beside the tables.
DERIVED = {
    "sales_summary_by_age_group": reports.sales_by_category_age,
    "mv_store_sales_stats": reports.store_sales_stats,
    "store_directory": reports.chain_directory,
    "store_scores": reports.store_scores,
}

# Definitions, and the view each reads.
FUNCTIONS = [
    (
        f"""get_contact_email(name STRING) RETURNS STRING
        RETURN concat(name, '{MAIL_DOMAIN}')""",
        None,
    ),
    (
        """sale_price(price DECIMAL(12,2), discount DECIMAL(5,2)) RETURNS DECIMAL(10,2)
        RETURN CAST(price * (100 - discount) * 0.01 AS DECIMAL(10,2))""",
        None,
    ),
    (
        """store_count(id BIGINT) RETURNS BIGINT
        RETURN coalesce((SELECT max(d.store_count) FROM store_directory d WHERE d.store_id = id), 0L)""",
        "store_directory",
    ),
    (
        """store_id_to_store_chain(id BIGINT) RETURNS STRING
        RETURN (SELECT max(d.store_chain_name) FROM store_directory d WHERE d.store_id = id)""",
        "store_directory",
    ),
    (
        """store_score(id BIGINT) RETURNS DOUBLE
        RETURN (SELECT max(s.score) FROM store_scores s WHERE s.store_id = id)""",
        "store_scores",
    ),
    (
        """get_sale_price(purchase STRING, product STRING, store BIGINT, customer BIGINT) RETURNS DECIMAL(10,2)
        RETURN (SELECT max(CAST(p.purchased_product_price_usd * (100 - p.discount_percent) * 0.01 AS DECIMAL(10,2)))
                FROM purchase p WHERE p.purchase_id = purchase AND p.product_id = product
                AND p.store_id = store AND p.customer_id = customer)""",
        "purchase",
    ),
    (
        """user_salt(name STRING) RETURNS STRING
        RETURN (SELECT max(u.salt) FROM user_info u WHERE u.username = name)""",
        "user_info",
    ),
    (
        """user_kind(name STRING) RETURNS INT
        RETURN (SELECT max(CASE WHEN u.is_admin = 1 THEN 2 ELSE 1 END) FROM user_info u WHERE u.username = name)""",
        "user_info",
    ),
    (
        """digest_holders(digest BINARY) RETURNS BIGINT
        RETURN (SELECT count(*) FROM user_info u WHERE u.password_hash = digest)""",
        "user_info",
    ),
    (
        """authenticate(name STRING, secret STRING) RETURNS INT
        RETURN CASE WHEN digest_holders(unhex(sha2(concat(user_salt(name), secret), 256))) = 1
                    THEN user_kind(name) ELSE 0 END""",
        "user_info",
    ),
]


def register(spark: SparkSession, tables: RetailTables, views: Collection[str] | None = None) -> None:
    """Create the views and functions in the session; existing ones are replaced.

    A derived result that ``tables`` has as a stored table (``mv_store_sales_stats`` of a
    version) is read as stored, not computed again. With ``views`` only these views and the
    functions on them are made, so that no table is built that a query does not name.
    """
    wanted = {*tables.names(), *DERIVED} if views is None else set(views)
    for name in tables.names():
        if name in wanted:
            tables[name].createOrReplaceTempView(name)
    for name, report in DERIVED.items():
        if name in wanted and name not in tables:
            report(tables).createOrReplaceTempView(name)
    for definition, view in FUNCTIONS:
        if view is None or views is None or view in wanted:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")


def run(spark: SparkSession, query: str, **parameters) -> DataFrame:
    """A SQL query with named parameters, ``:name`` in the text."""
    return spark.sql(query, args=parameters)

"""User table jobs: batch load, digest check and digest rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise import schema
from tillwise.functions.digests import digest_bytes, salt, salted_digest
from tillwise.sources.tables import RetailTables

# Results of the digest check.
REFUSED, CLIENT, ADMIN = 0, 1, 2


NAME_KEY = "name_key"


def name_key(collation: str | None) -> Column:
    """The user name as it is compared: byte by byte, or under a collation (``UTF8_LCASE``)."""
    name = F.col("username") if collation is None else F.collate("username", collation)
    return name.alias(NAME_KEY)


def add_users(requests: DataFrame, user_info: DataFrame, salt_key: str, collation: str | None = None) -> RetailTables:
    """Rows to append to ``user_info``, ``client`` and ``admin``.

    Of several requests for one name the earliest ``arrival`` wins; names already present
    are skipped. Under a collation ``Bob`` and ``bob`` are one name, spelled as the first asked.
    """
    details = [c for c in requests.columns if c != "arrival"]
    keyed = requests.select(name_key(collation), "arrival", F.struct(*details).alias("details"))
    first = keyed.groupBy(NAME_KEY).agg(F.min_by("details", "arrival").alias("request"))
    new = first.join(user_info.select(name_key(collation)), NAME_KEY, "left_anti").select("request.*")
    salted = new.withColumn("salt", salt(F.col("username"), salt_key))
    digest = digest_bytes(salted_digest(F.col("salt"), F.col("secret")))
    is_admin = F.coalesce(F.col("is_admin") == 1, F.lit(False))
    return RetailTables(
        {
            "user_info": schema.conform(salted.withColumn("password_hash", digest), "user_info"),
            "client": schema.conform(new.filter(~is_admin), "client"),
            "admin": schema.conform(new.filter(is_admin), "admin"),
        }
    )


def check_digests(attempts: DataFrame, user_info: DataFrame, collation: str | None = None) -> DataFrame:
    """``username, secret`` attempts with ``result``: 0 refused, 1 client, 2 administrator.

    The digest made with the named user's salt must be stored for exactly one user. Names are
    compared as in :func:`add_users`; the secret counts as it is.
    """
    salts = user_info.select(name_key(collation), "salt", "is_admin")
    stored = user_info.groupBy("password_hash").agg(F.count("*").alias("holders"))
    digest = digest_bytes(salted_digest(F.col("salt"), F.col("secret")))
    accepted = F.when(F.col("is_admin") == 1, ADMIN).otherwise(CLIENT)
    return (
        attempts.withColumn(NAME_KEY, name_key(collation))
        .join(salts, NAME_KEY, "left")
        .withColumn("password_hash", digest)
        .join(stored, "password_hash", "left")
        .select(*attempts.columns, F.when(F.col("holders") == 1, accepted).otherwise(REFUSED).alias("result"))
    )


def rotate_digests(user_info: DataFrame, changes: DataFrame, salt_key: str) -> DataFrame:
    """``user_info`` with new salts and digests; the latest ``arrival`` of a name wins.

    Changes for unknown names are ignored.
    """
    latest = changes.groupBy("username").agg(
        F.max_by("secret", "arrival").alias("secret"), F.max("arrival").alias("arrival")
    )
    identity = F.concat("username", F.lit(":"), F.col("arrival").cast("string"))
    salted = latest.withColumn("new_salt", salt(identity, salt_key))
    renewed = salted.select(
        "username",
        "new_salt",
        digest_bytes(salted_digest(F.col("new_salt"), F.col("secret"))).alias("new_hash"),
    )
    return schema.conform(
        user_info.join(renewed, "username", "left").withColumns(
            {
                "salt": F.coalesce("new_salt", "salt"),
                "password_hash": F.coalesce("new_hash", "password_hash"),
            }
        ),
        "user_info",
    )


def public_users(user_info: DataFrame) -> DataFrame:
    """User columns without salt and digest."""
    return user_info.select("username", "first_name", "last_name", "is_admin")

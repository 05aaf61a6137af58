"""Flat sales files: read, type, and split into the seven retail tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise import schema
from tillwise.sources.tables import RetailTables

# Layout of the flat file.
SEPARATOR = ","
NULL_MARK = "\\N"
NUMBER_AT_START = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

RAW_LINE = "raw_line"
ISSUES = "load_issues"


def read_text_fields(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """The fields as text, header skipped, plus the raw line when its field count is wrong.

    By default quotes are ordinary characters and only ``\\n`` ends a line. ``clean`` honours
    quotes, accepts any line end and trims.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.STAGING.fields])
    text.add(RAW_LINE, T.StringType())
    reader = (
        spark.read.schema(text)
        .option("header", True)
        .option("sep", SEPARATOR)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW_LINE)
    )
    if clean:
        reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    else:
        reader = reader.option("quote", "").option("lineSep", "\n")
    return reader.csv(path)


def typed_staging(fields: DataFrame, mysql_coerce: bool = False) -> DataFrame:
    """Declared staging types.

    A field that cannot be read becomes NULL and is named in ``load_issues``. With
    ``mysql_coerce`` numbers are read from the start of the field, clamped to the type and
    0 when there is none, text is cut to its width, and an empty field is 0 or ''.
    """
    columns, issues = [], []
    for field in schema.STAGING.fields:
        raw = F.when(F.col(field.name) != NULL_MARK, F.col(field.name))
        present = F.coalesce(F.col(field.name) != NULL_MARK, F.lit(True))
        strict = raw.try_cast(field.dataType)
        value = _coerced(raw, present, field) if mysql_coerce else strict
        columns.append(value.alias(field.name))
        issues.append(F.when(raw.isNotNull() & strict.isNull(), F.lit(f"{field.name}: not a {_kind(field)}")))
    issues.append(F.when(F.col(RAW_LINE).isNotNull(), F.lit("wrong number of fields")))
    return fields.select(*columns, F.array_compact(F.array(*issues)).alias(ISSUES))


def _kind(field: T.StructField) -> str:
    return field.dataType.simpleString()


def _coerced(raw: Column, present: Column, field: T.StructField) -> Column:
    kind = field.dataType
    if isinstance(kind, T.DateType):
        return raw.try_cast(kind)
    if isinstance(kind, T.StringType):
        width = schema.STAGING_WIDTHS[field.name]
        return F.when(present, F.left(F.coalesce(raw, F.lit("")), F.lit(width)))
    number = F.coalesce(F.regexp_extract(raw, NUMBER_AT_START, 1).try_cast("double"), F.lit(0.0))
    if isinstance(kind, T.IntegerType):
        number = F.least(F.greatest(F.round(number), F.lit(-2147483648.0)), F.lit(2147483647.0))
    if isinstance(kind, T.DecimalType):
        bound = 10.0 ** (kind.precision - kind.scale) - 10.0**-kind.scale
        number = F.least(F.greatest(number, F.lit(-bound)), F.lit(bound))
    return F.when(present, number.cast(kind))


def read_staging(spark: SparkSession, path: str, clean: bool = False, mysql_coerce: bool = False) -> DataFrame:
    """The typed flat file with a ``load_issues`` array per row."""
    return typed_staging(read_text_fields(spark, path, clean), mysql_coerce)


def quarantine(staging: DataFrame) -> DataFrame:
    """Rows with at least one unreadable field."""
    return staging.filter(F.size(ISSUES) > 0)


def store_staging(staging: DataFrame, folder: str) -> DataFrame:
    """Write the typed rows once as parquet; each target table then reads only its columns."""
    staging.write.mode("overwrite").parquet(folder)
    return staging.sparkSession.read.schema(staging.schema).parquet(folder)


def write_flat(staging: DataFrame, path: str, compression: str = "none") -> None:
    """Write staging rows in the flat layout; readers take packed files by their names."""
    staging.select(*schema.STAGING.names).write.mode("overwrite").option("header", True).option(
        "nullValue", NULL_MARK
    ).csv(path, compression=compression)


def normalise(staging: DataFrame) -> RetailTables:
    """The seven retail tables as distinct projections of the flat rows."""

    def distinct(*columns: str | Column) -> DataFrame:
        return staging.select(*columns).distinct()

    return RetailTables(
        {
            "customer": lambda: distinct(
                "customer_id",
                "age",
                "gender",
                F.col("annual_income_usd").try_cast("decimal(8,2)").alias("annual_income_usd"),
                "full_name",
            ).filter(F.col("customer_id").isNotNull()),
            "store": lambda: distinct("store_id", "store_location", "store_chain_name", "year_opened"),
            "product": lambda: distinct("product_id", "product_category"),
            "inventory": lambda: distinct(
                "product_id",
                "store_id",
                "store_location",
                "qty",
                _money_or_zero("product_price_usd", "decimal(8,2)"),
                _money_or_zero("product_cost_usd", "decimal(6,2)"),
                F.col("competitor_price_usd").try_cast("decimal(8,2)").alias("competitor_price_usd"),
            ),
            "popularity": lambda: distinct("store_id", "store_location", "visit_date", "foot_traffic"),
            "purchase": lambda: distinct(
                "purchase_id",
                "product_id",
                "store_id",
                "customer_id",
                "payment_method",
                "discount_percent",
                F.col("purchase_date").alias("txn_date"),
                "store_location",
                "purchased_product_price_usd",
            ).filter(F.col("purchase_id").isNotNull()),
            "customer_visits": lambda: distinct(
                "customer_id",
                "store_id",
                "store_location",
                F.when(F.col("is_favorite") > 0, True).otherwise(False).alias("is_favorite"),
            ),
        }
    )


def _money_or_zero(name: str, kind: str) -> Column:
    """0.00 for a missing amount; NULL, for the audit to find, when it does not fit."""
    return F.when(F.col(name).isNull(), F.lit("0.00").cast(kind)).otherwise(F.col(name).try_cast(kind)).alias(name)

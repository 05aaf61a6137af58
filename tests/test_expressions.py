import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from tillwise.functions import ages, digests, money, text


def column(spark, values, expression, kind="int"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [row[0] for row in df.select(expression(F.col("x"))).collect()]


def test_age_range_takes_the_first_band(spark):
    ages_in = [0, 9, 10, 17, 18, 20, 25, 26, 36, 40, 49, 50, 51, 60, 89, 90, 99, None]
    assert column(spark, ages_in, ages.age_range) == [
        "0-9", "0-9", "10-20", "10-20", "10-20", "10-20", "20-29", "20-29", "30-39", "40-49",
        "40-49", "50-59", "50-59", "60-69", "80-89", "90+", "90+", "90+",
    ]


def test_age_group_puts_minors_last_and_never_uses_40_49(spark):
    ages_in = [0, 17, 18, 25, 26, 36, 40, 49, 50, 51, 60, 89, 90, None]
    assert column(spark, ages_in, ages.age_group) == [
        "90+", "90+", "18-25", "18-25", "26-35", "36-50", "36-50", "36-50", "36-50", "50-59",
        "60-69", "80-89", "90+", "90+",
    ]


def test_sale_price_rounds_half_up_exactly(spark):
    rows = [("899.75", 10), ("945.89", 0), ("100.00", 20), ("0.50", 1), ("9999.99", 100), ("1.50", 33)]
    df = spark.createDataFrame(rows, "p string, d int").select(
        money.sale_price(F.col("p").cast("decimal(6,2)"), F.col("d")).alias("sale")
    )
    assert df.schema["sale"].dataType.simpleString() == "decimal(10,2)"
    expected = ["809.78", "945.89", "80.00", "0.50", "0.00", "1.01"]
    assert [str(row.sale) for row in df.collect()] == expected


def test_exact_average(spark):
    rows = [(5, 2), (1, 3), (2, 3), (0, 5), (7, 0), (None, None)]
    df = spark.createDataFrame(rows, "total bigint, n bigint").select(
        money.exact_average(F.col("total") * 100, F.col("n"), 2).alias("a")
    )
    assert [row.a for row in df.collect()] == [
        Decimal("2.50"), Decimal("0.33"), Decimal("0.67"), Decimal("0.00"), None, None
    ]


def test_contact_email(spark):
    assert column(spark, ["jwoodwell", None], text.contact_email, "string") == ["jwoodwell@retail_stats.com", None]


def test_text_predicates(spark):
    assert column(spark, ["ab_9", "a b", "é", ""], text.is_word, "string") == [True, False, False, False]
    assert column(spark, ["+1 (555) 1-2", "call me"], text.is_phone, "string") == [True, False]


def test_numbers_in_text(spark):
    assert column(spark, ["12", "P1", "12abc", None], text.as_number, "string") == [12, None, None, None]
    leading = column(spark, ["12", "P1", "12abc", None], lambda c: text.as_number(c, leading_digits=True), "string")
    assert leading == [12, 0, 12, None]
    assert column(spark, ["007", "8"], lambda c: text.same_number(c, F.lit(7)), "string") == [True, False]


def test_collated_equality(spark):
    values = ["M", "m", "x"]
    assert column(spark, values, lambda c: text.same_text(c, F.lit("m")), "string") == [False, True, False]
    insensitive = column(spark, values, lambda c: text.same_text(c, F.lit("m"), "UTF8_LCASE"), "string")
    assert insensitive == [True, True, False]


def test_strict_dates(spark):
    values = ["2023-06-01", "2023-6-1", "2023-02-30", "01/06/2023", "", "2023-06-01x"]
    parsed = column(spark, values, text.strict_date, "string")
    assert [None if d is None else d.isoformat() for d in parsed] == [
        "2023-06-01", "2023-06-01", None, None, None, None
    ]


def test_salt_is_stable_printable_and_bounded(spark):
    names = ["a", "b", "c"]
    salts = column(spark, names, lambda c: digests.salt(c, "key"), "string")
    assert salts == column(spark, names, lambda c: digests.salt(c, "key"), "string")
    assert len(set(salts)) == 3
    assert all(len(s) == 8 and all(32 <= ord(ch) <= 126 for ch in s) for s in salts)
    assert salts != column(spark, names, lambda c: digests.salt(c, "other"), "string")
    assert {len(s) for s in column(spark, names, lambda c: digests.salt(c, "key", 50), "string")} == {20}


def test_salted_digest_matches_sha256(spark):
    df = spark.createDataFrame([("saltsalt", "secret")], "salt string, secret string")
    digest = df.select(digests.digest_bytes(digests.salted_digest(F.col("salt"), F.col("secret")))).first()[0]
    assert bytes(digest) == hashlib.sha256(b"saltsaltsecret").digest()

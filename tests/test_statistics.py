import random
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from tillwise.functions.money import total
from tillwise.operators.statistics import discount_outliers, finish, merge, parts, step_rounded_average


def purchases(table, discounts, store=1, price="100.00", start=1):
    return table(
        "purchase",
        [(start + i, "1", store, 1, "Cash", d, "2023-01-01", "A", price) for i, d in enumerate(discounts)],
    )


def average(df):
    return {r.store_id: (r.num_purchases, str(r.avg_discount)) for r in df.collect()}


def step_loop(discounts, a=0, n=0):
    for d in discounts:
        a = ((a * n + d * 100) * 2 + n + 1) // (2 * (n + 1))
        n += 1
    return n, f"{a / 100:.2f}"


@pytest.mark.parametrize(
    "discounts, expected",
    [([1], "1.00"), ([1, 2], "1.50"), ([1, 2, 2], "1.67"), ([0, 0, 0, 0, 0, 1], "0.17"), ([0, 0, 0, 0, 0, 1, 0], "0.15")],
)
def test_rounding_at_every_step(table, discounts, expected):
    assert average(step_rounded_average(purchases(table, discounts))) == {1: (len(discounts), expected)}


def test_exact_average_differs_from_stepwise(table):
    exact = finish(parts(purchases(table, [0, 0, 0, 0, 0, 1, 0]))).first()
    assert exact.avg_discount == Decimal("0.14")


def test_stepwise_average_of_many_sales_needs_only_the_first(table):
    rng = random.Random(4)
    narrow = [rng.choice([3, 4]) for _ in range(500)]
    wide = [rng.randrange(0, 101) for _ in range(400)]
    equal = [7] * 30
    frame = (
        purchases(table, narrow, 1)
        .unionByName(purchases(table, wide, 2, start=1000))
        .unionByName(purchases(table, equal, 3, start=2000))
    )
    expected = {1: step_loop(narrow), 2: step_loop(wide), 3: step_loop(equal)}
    assert average(step_rounded_average(frame)) == expected


def test_stepwise_average_continues_from_stored_statistics(spark, table):
    rng = random.Random(5)
    first, second = [rng.randrange(0, 60) for _ in range(80)], [rng.randrange(0, 60) for _ in range(90)]
    stored = step_rounded_average(purchases(table, first))
    both = step_rounded_average(purchases(table, second, start=100), stored)
    assert average(both) == {1: step_loop(first + second)}
    frozen = spark.createDataFrame([(1, 50_000, "10.00")], "store_id int, num_purchases bigint, a string").selectExpr(
        "store_id", "num_purchases", "CAST(a AS DECIMAL(5,2)) AS avg_discount"
    )
    assert average(step_rounded_average(purchases(table, [90, 0]), frozen)) == {1: (50_002, "10.00")}


def test_merge_of_batches_equals_full_rebuild(table):
    first = purchases(table, [0, 10, 20], 1, "9999.99").unionByName(purchases(table, [5], 2, "0.50", 50))
    second = purchases(table, [30, 1], 1, "3.33", 100).unionByName(purchases(table, [100], 3, "7.00", 200))
    merged = finish(merge(parts(first), parts(second)))
    rebuilt = finish(parts(first.unionByName(second)))
    assert merged.dtypes == rebuilt.dtypes
    assert sorted(merged.collect()) == sorted(rebuilt.collect())


def test_first_sale_of_a_store(table):
    row = finish(parts(purchases(table, [20], 101))).first()
    expected = ("80.00", 1, "20.00", "80.00", "80.00")
    assert (str(row.total_sales), row.num_purchases, str(row.avg_discount), str(row.min_price), str(row.max_price)) == expected


def test_merged_totals_are_wider_than_one_batch(table):
    large = parts(purchases(table, [0], 1, "9999.99")).selectExpr(
        "store_id", "CAST(total_sales * 10000000000000 AS DECIMAL(20,2)) AS total_sales", "num_purchases",
        "discount_total", "discount_count", "min_price", "max_price",
    )
    assert merge(large, large, large).first().total_sales == Decimal("9999.99") * 10**13 * 3


def test_average_of_known_discounts_only(table):
    row = finish(parts(purchases(table, [10, None]))).first()
    assert (row.num_purchases, row.avg_discount) == (2, Decimal("10.00"))
    assert finish(parts(purchases(table, [None]))).first().avg_discount is None
    merged = merge(parts(purchases(table, [10, None])), parts(purchases(table, [None, 20], start=10)))
    assert finish(merged).first().avg_discount == Decimal("15.00")


def test_negative_averages_round_away_from_zero(table):
    assert finish(parts(purchases(table, [-1, -2]))).first().avg_discount == Decimal("-1.50")
    assert finish(parts(purchases(table, [-1, 0, 0, 0, 0, 0, 0, 0]))).first().avg_discount == Decimal("-0.13")


def test_an_outlier_does_not_enter_the_stepwise_fold(table):
    sales = purchases(table, [10, 20, 2_000_000, None, -3])
    assert average(step_rounded_average(sales)) == {1: (5, "15.00")}
    assert sorted(str(r.discount_percent) for r in discount_outliers(sales).collect()) == ["-3", "2000000", "None"]


def test_a_store_of_outliers_has_no_stepwise_average_and_a_wide_average_is_null(table):
    assert {r.store_id: (r.num_purchases, r.avg_discount) for r in step_rounded_average(purchases(table, [-5, 300])).collect()} == {1: (2, None)}
    assert average(step_rounded_average(purchases(table, [-5, 10, 20]))) == {1: (3, "13.33")}
    row = finish(parts(purchases(table, [2000, 10]))).first()
    assert (row.num_purchases, row.avg_discount) == (2, None)


def test_large_sales_are_summed(spark):
    sales = spark.sql("SELECT 1L AS store_id, CAST(9999999999.99 AS DECIMAL(12,2)) AS purchased_product_price_usd, 0 AS discount_percent")
    assert sales.agg(total(F.col("purchased_product_price_usd"))).first()[0] == Decimal("9999999999.99")

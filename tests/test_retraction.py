import random

import pytest

from tillwise.operators import statistics
from tillwise.operators.retraction import StoreStats


def sale(number, store, location, customer, price, discount):
    return (str(number), "1", store, customer, "Cash", discount, "2023-01-01", location, price)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    stores = [(1, "A"), (1, "B"), (2, "A"), (3, "C"), (None, "A"), (4, None)]
    return [
        sale(n, *rng.choice(stores), rng.randrange(6), f"{rng.randrange(1, 9)}.{rng.randrange(100):02d}", rng.choice([0, 10, 33, None]))
        for n in range(200)
    ]


def reported(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rebuilt(table, rows):
    return reported(statistics.finish(statistics.parts(table("purchase", rows))))


def test_counted_at_once_or_in_parts(table, rows):
    whole = StoreStats.of(table("purchase", rows))
    parts = StoreStats.of(table("purchase", rows[:90])).plus(StoreStats.of(table("purchase", rows[90:])))
    assert reported(whole.finish()) == reported(parts.finish()) == rebuilt(table, rows)


def test_removed_sales_take_their_extremes_along(table, rows):
    gone = [r for r in rows if r[3] in (1, 4)]
    left = StoreStats.of(table("purchase", rows)).minus(StoreStats.of(table("purchase", gone)))
    assert reported(left.finish()) == rebuilt(table, [r for r in rows if r[3] not in (1, 4)])
    assert left.negative().count() == 0 and left.minus(StoreStats.of(table("purchase", gone[:1]))).negative().count() == 1
    assert left.minus(StoreStats.of(table("purchase", [r for r in rows if r[3] not in (1, 4)]))).finish().count() == 0


def test_deleted_and_renamed_stores(spark, table, rows):
    stats = StoreStats.of(table("purchase", rows))
    removed = spark.createDataFrame([(1, "B"), (9, "Z")], "store_id int, store_location string")
    renamed = spark.createDataFrame(
        [(1, "A", 2, "A2"), (3, "C", 2, "A")], "store_id int, store_location string, new_store_id int, new_store_location string"
    )
    moved = {(1, "A"): (2, "A2"), (3, "C"): (2, "A")}
    after = [(*r[:2], *[moved.get((r[2], r[7]), (r[2], r[7]))[0]], *r[3:7], moved.get((r[2], r[7]), (r[2], r[7]))[1], r[8]) for r in rows if (r[2], r[7]) != (1, "B")]
    assert reported(stats.without_stores(removed).with_stores_renamed(renamed).finish()) == rebuilt(table, after)

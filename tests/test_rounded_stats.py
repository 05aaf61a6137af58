import os
import random

import pytest

from tests.test_statistics import purchases
from tillwise.operators.statistics import step_rounded_average
from tillwise.streaming import rounded_stats
from tillwise.streaming.rounded_stats import current_averages, rounded, start_rounded_stats


def run(spark, source, work):
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = start_rounded_stats(stream, f"{work}/updates", f"{work}/checkpoint")
    query.awaitTermination()
    return {r.store_id: (r.num_purchases, r.avg_discount) for r in current_averages(spark.read.parquet(f"{work}/updates")).collect()}


def plain(batches):
    n, cents = 0, None
    for discounts in batches:
        for d in discounts:
            if d is not None and 0 <= d <= 100:
                cents = d * 100 if cents is None else rounded(cents * n + d * 100, n + 1)
            n += 1
    return n, cents


def test_three_runs_of_one_stream_go_on_with_the_state(spark, table, tmp_path):
    rng, source = random.Random(4), str(tmp_path / "sales")
    batches = [[rng.choice([0, 1, 2, 5, 33, 100, None, 300]) for _ in range(40)] for _ in range(3)]
    for number, discounts in enumerate(batches):
        purchases(table, discounts, start=1000 * number).coalesce(1).write.mode("append").parquet(source)
        found = run(spark, source, tmp_path)
        n, cents = plain(batches[: number + 1])
        assert {k: (m, int(a * 100)) for k, (m, a) in found.items()} == {1: (n, cents)}
    # Nothing new: a run changes nothing.
    assert run(spark, source, tmp_path) == found
    updates = spark.read.parquet(f"{tmp_path}/updates")
    assert updates.count() == 3


def test_one_batch_equals_the_batch_operator(spark, table, tmp_path):
    rng = random.Random(5)
    sales = purchases(table, [rng.choice([0, 3, 50, 100]) for _ in range(200)])
    sales.repartition(3).write.parquet(str(tmp_path / "sales"))
    found = run(spark, str(tmp_path / "sales"), tmp_path)
    assert found == {r.store_id: (r.num_purchases, r.avg_discount) for r in step_rounded_average(sales).collect()}


def test_only_the_first_sales_are_folded_once_the_average_cannot_move(spark, table, tmp_path, monkeypatch):
    sales = purchases(table, [10] * 30 + [None, 300])
    sales.write.parquet(str(tmp_path / "sales"))
    assert {k: (n, str(a)) for k, (n, a) in run(spark, str(tmp_path / "sales"), tmp_path).items()} == {1: (32, "10.00")}

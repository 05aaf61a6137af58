import os

import pytest
from pyspark.sql import functions as F

from tests.test_quality import GOOD, small_tables
from tillwise import schema, session
from tillwise.operators import statistics
from tillwise.streaming.ledger import SalesLedger
from tillwise.streaming import live_stats
from tillwise.streaming.live_stats import current_stats, start_live_stats

NAMES = schema.TABLES["purchase"].names
TEXT = ", ".join(f"{n} string" for n in NAMES)


def batch(spark, *changes):
    rows = [tuple({**GOOD, **change}[n] for n in NAMES) for change in changes]
    return spark.createDataFrame(rows, TEXT)


@pytest.fixture
def ledger(spark, table, tmp_path):
    return SalesLedger.create(spark, str(tmp_path / "ledger"), small_tables(table), F.lit("2024-01-01").cast("date"))


def state(ledger):
    stock = {r.product_id: r.qty for r in ledger.inventory().collect()}
    stats = {r.store_id: (str(r.total_sales), r.num_purchases, str(r.avg_discount)) for r in ledger.stats().collect()}
    refused = sorted((r.purchase_id, tuple(r.reasons)) for r in ledger.refused().collect())
    return stock, stats, refused, ledger.purchases().count()


FIRST = [{"purchase_id": str(n)} for n in range(10, 13)] + [{"purchase_id": "7"}]
SECOND = [{"purchase_id": str(n)} for n in range(20, 24)] + [{"purchase_id": "12"}]
AFTER_BOTH = (
    {"1": 0, "2": 5},
    {1: ("460.00", 6, "8.33")},
    [
        ("12", ("purchase_id is taken",)),
        ("22", ("out of stock",)),
        ("23", ("out of stock",)),
        ("7", ("purchase_id is taken",)),
    ],
    6,
)


def test_batches_update_stock_and_statistics(spark, ledger):
    assert state(ledger) == ({"1": 5, "2": 5}, {1: ("10.00", 1, "0.00")}, [], 1)
    ledger.apply_batch(batch(spark, *FIRST), 0, "one")
    assert state(ledger)[:2] == ({"1": 2, "2": 5}, {1: ("280.00", 4, "7.50")})
    ledger.apply_batch(batch(spark, *SECOND), 1, "one")
    assert state(ledger) == AFTER_BOTH


def test_replays_change_nothing(spark, ledger):
    ledger.apply_batch(batch(spark, *FIRST), 0, "one")
    ledger.apply_batch(batch(spark, *FIRST), 0, "one")
    ledger.apply_batch(batch(spark, *SECOND), 1, "one")
    ledger.apply_batch(batch(spark, *SECOND), 1, "one")
    assert state(ledger) == AFTER_BOTH


def test_a_batch_leaves_no_intermediates(spark, ledger):
    shared = session.shared_folder(spark)
    before = {name for name, *_ in session.listing(spark, shared)} if os.path.isdir(shared) else set()
    ledger.apply_batch(batch(spark, *FIRST), 0, "one")
    assert {name for name, *_ in session.listing(spark, shared)} <= before
    assert state(ledger)[3] == 4


def test_another_stream_goes_on_behind_the_first(spark, ledger):
    ledger.apply_batch(batch(spark, *FIRST), 0, "one")
    ledger.apply_batch(batch(spark, *SECOND), 0, "two")
    ledger.apply_batch(batch(spark, *SECOND), 0, "two")
    assert state(ledger) == AFTER_BOTH


def test_a_new_checkpoint_loses_nothing(spark, ledger, tmp_path):
    source = str(tmp_path / "source")
    for number, entered in enumerate([FIRST, SECOND]):
        batch(spark, *entered).coalesce(1).write.mode("append").parquet(source)
        ledger.start(spark.readStream.schema(TEXT).parquet(source), str(tmp_path / f"checkpoint-{number}")).awaitTermination()
    # The second stream brings the first rows again; they are refused as taken, not lost.
    assert ledger.purchases().count() == AFTER_BOTH[3]
    assert state(ledger)[:2] == AFTER_BOTH[:2]


def test_an_overlong_id_is_refused_and_does_not_stop_the_stream(spark, ledger):
    ledger.apply_batch(batch(spark, {"purchase_id": "30", "customer_id": "9" * 25}, {"purchase_id": "31"}), 0, "one")
    assert state(ledger)[2:] == ([("30", ("customer_id is unknown",))], 2)


def test_compaction_by_itself(spark, ledger, monkeypatch):
    from tillwise.streaming import ledger as module

    monkeypatch.setattr(module, "COMPACT_AFTER", 2)
    for number in range(5):
        ledger.apply_batch(batch(spark, {"purchase_id": str(50 + number)}), number, "one")
    assert ledger.last_commit()["base"] == 3 and ledger.last_commit()["batch_id"] == 4
    assert len(spark.read.parquet(f"{ledger.folder}/commits/*").inputFiles()) == 2
    assert state(ledger)[0] == {"1": 0, "2": 5} and ledger.purchases().count() == 6


def test_a_batch_that_fails_before_its_commit_leaves_no_trace(spark, ledger, monkeypatch):
    ledger.apply_batch(batch(spark, *FIRST), 0, "one")
    before = state(ledger)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(SalesLedger, "_commit", fail)
        with pytest.raises(RuntimeError):
            ledger.apply_batch(batch(spark, *SECOND), 1, "one")
    assert state(ledger) == before
    ledger.apply_batch(batch(spark, *SECOND), 1, "one")
    assert state(ledger) == AFTER_BOTH


def test_compaction_keeps_the_state(spark, ledger):
    ledger.apply_batch(batch(spark, *FIRST), 0, "one")
    ledger.compact()
    ledger.compact()
    ledger.apply_batch(batch(spark, *SECOND), 1, "one")
    assert state(ledger) == AFTER_BOTH
    ledger.compact()
    assert state(ledger) == AFTER_BOTH


def test_step_rounded_averages_follow_the_batches(spark, table, tmp_path):
    ledger = SalesLedger.create(
        spark, str(tmp_path / "ledger"), small_tables(table), F.lit("2024-01-01").cast("date"), step_rounded=True
    )
    discounts = iter([1, 2, 2, 50, 0])
    expected_n, expected = 1, 0
    for number, size in enumerate((3, 2)):
        entered = [{"purchase_id": str(10 + 10 * number + i), "discount_percent": str(next(discounts))} for i in range(size)]
        for change in entered:
            d = int(change["discount_percent"]) * 100
            expected = ((expected * expected_n + d) * 2 + expected_n + 1) // (2 * (expected_n + 1))
            expected_n += 1
        ledger.apply_batch(batch(spark, *entered), number, "one")
        row = ledger.step_rounded_averages().first()
        assert (row.store_id, row.num_purchases, int(row.avg_discount * 100)) == (1, expected_n, expected)


def test_stream_of_files_in_two_runs(spark, ledger, tmp_path):
    source, checkpoint = str(tmp_path / "arrivals"), str(tmp_path / "checkpoint")
    for part in (FIRST, SECOND):
        batch(spark, *part).coalesce(1).write.mode("append").parquet(source)
        ledger.start(spark.readStream.schema(TEXT).parquet(source), checkpoint).awaitTermination()
    assert state(ledger) == AFTER_BOTH


@pytest.mark.parametrize("compact_after", [16, 2])
def test_live_statistics_equal_the_batch_rebuild(spark, table, tmp_path, monkeypatch, compact_after):
    monkeypatch.setattr(live_stats, "COMPACT_AFTER", compact_after)
    source, updates, checkpoint = (str(tmp_path / name) for name in ("arrivals", "updates", "checkpoint"))
    parts = [
        table("purchase", [(i, "1", i % 3, 1, "Cash", i % 7, "2023-01-01", "A", f"{i}.50") for i in numbers])
        for numbers in (range(1, 30), range(30, 45), range(45, 50))
    ]
    for part in parts:
        part.write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(part.schema).parquet(source)
        start_live_stats(arrivals, updates, checkpoint).awaitTermination()
    live = current_stats(spark.read.parquet(updates))
    rebuilt = statistics.finish(statistics.parts(spark.read.schema(parts[0].schema).parquet(source)))
    assert sorted(live.collect()) == sorted(rebuilt.collect())
    kept = sorted(name for name, *_ in session.listing(spark, updates) if name.startswith("batch_id="))
    assert kept == (["batch_id=3", "batch_id=4"] if compact_after == 2 else ["batch_id=0", "batch_id=2", "batch_id=4"])

"""Properties the physical plans must keep when no side is small enough to broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tillwise.operators import quality, stock
from tillwise.plans import reports
from tillwise.sources.mapping import load_tables

JOBS = {
    "store_performance": reports.store_performance,
    "sales_by_category_age": reports.sales_by_category_age,
    "gender_stats": reports.gender_stats,
    "gender_by_category": lambda tables: reports.gender_by_category(tables, "Books"),
    "top_chain_by_age_group": reports.top_chain_by_age_group,
    "store_profit": reports.store_profit,
    "store_scores": reports.store_scores,
    "top_inventory": reports.top_inventory,
    "stock_admission": lambda tables: stock.admit_sales(tables.purchase, tables.inventory),
    "orphans": lambda tables: quality.table_orphans(tables, "purchase"),
}


@pytest.fixture
def tables(spark):
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in limits:
        spark.conf.set(name, "-1")
    yield load_tables(spark, SMALL)
    for name in limits:
        spark.conf.unset(name)


def plan_of(df):
    """The initial physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(JOBS))
def test_no_join_without_keys(tables, name):
    plan = plan_of(JOBS[name](tables))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    lines = plan.splitlines()
    for above, below in zip(lines, lines[1:], strict=False):
        if "Exchange SinglePartition" in above:  # only a global count, one row per task
            assert "HashAggregate(keys=[], functions=[partial_count" in below


def scans_of(plan):
    return re.findall(r"FileScan parquet \[([^\]]*)\]", plan)


def columns_read(plan):
    return [{re.sub(r"#\d+L?", "", c) for c in scan.split(",")} for scan in scans_of(plan)]


def test_scans_read_only_the_needed_columns(tables):
    read = columns_read(plan_of(reports.gender_stats(tables)))
    assert {"customer_id", "purchase_id", "purchased_product_price_usd"} in read
    assert {"customer_id", "gender"} in read


def test_category_filter_reaches_the_scan(tables):
    plan = plan_of(reports.gender_by_category(tables, "Books"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(product_category,Books\)", plan)


def test_items_are_shuffled_once_for_aggregate_and_join(tables):
    """Sales are combined before their only shuffle; the join reuses its partitioning."""
    plan = plan_of(reports.store_profit(tables))
    by_item = re.findall(r"Exchange hashpartitioning\(product_id#\d+, store_id#\d+L?, store_location#\d+", plan)
    assert len(by_item) == 2  # combined sales, inventory


def test_admission_shuffles_the_sales_once(tables):
    """Rank window and stock join share one partitioning on item and slice."""
    plan = plan_of(stock.admit_sales(tables.purchase, tables.inventory))
    window = plan.index("Window [row_number()")
    below = plan[window : plan.index("FileScan", window)]
    above = plan[:window]
    assert below.count("Exchange hashpartitioning(product_id") == 1
    assert "Exchange" not in above


def test_top_items_keep_a_bounded_heap(tables):
    assert "TakeOrderedAndProject" in plan_of(reports.top_inventory(tables))


def test_best_chain_is_limited_before_the_shuffle(tables):
    assert "WindowGroupLimit" in plan_of(reports.top_chain_by_age_group(tables))


def test_a_small_batch_does_not_shuffle_the_history(spark, table):
    """The batch is broadcast to the known purchases, customers and items."""
    from tests.test_quality import GOOD
    from tillwise import schema

    names = schema.TABLES["purchase"].names
    candidates = spark.createDataFrame([tuple(GOOD[n] for n in names)], ", ".join(f"{n} string" for n in names))
    history = load_tables(spark, SMALL)
    checked = quality._check_each_purchase(candidates, history, F.current_date(), 18)
    plan = plan_of(checked)
    scans = [line for line in plan.splitlines() if "FileScan parquet [purchase_id" in line and "entered" not in line]
    assert scans and "LeftSemi, BuildRight" in plan
    for keys in ("try_cast(purchase_id",):
        assert "SortMergeJoin" not in plan[: plan.index("FileScan parquet [purchase_id")] or keys not in plan

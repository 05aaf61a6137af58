import os

import pytest
from pyspark.sql import functions as F

from tests.test_quality import small_tables
from tillwise import schema
from tillwise.operators import statistics
from tillwise.plans import sql_surface
from tillwise.sources.tables import RetailTables
from tillwise.sources.versions import VersionConflict, VersionedTables


@pytest.fixture
def store(spark, tmp_path):
    return VersionedTables(spark, str(tmp_path / "retail"))


def sale(number, price="10.00"):
    return (str(number), "1", 1, 1, "Cash", 0, "2023-01-01", "A", price)


def totals(version):
    return {r.store_id: (str(r.total_sales), r.num_purchases) for r in version.table("mv_store_sales_stats").collect()}


def test_readers_stay_with_their_version(store, table):
    with pytest.raises(LookupError):
        store.open()
    first = store.load(small_tables(table))
    before = first.tables()
    second = store.append_purchases(first, table("purchase", [sale(8, "5.00"), sale(9, "1.00")]))
    assert (first.number, second.number, store.numbers()) == (1, 2, [1, 2])
    assert totals(first) == {1: ("10.00", 1)} and totals(second) == {1: ("16.00", 3)} == totals(store.open())
    assert before.purchase.count() == 1 and second.table("purchase").count() == 3
    # Tables that did not change are not written again.
    assert second.folders["store"] == first.folders["store"] and len(second.folders["purchase"]) == 2
    rebuilt = statistics.finish(statistics.parts(second.table("purchase")))
    assert schema.conform(rebuilt, "mv_store_sales_stats").exceptAll(second.table("mv_store_sales_stats")).count() == 0


def test_a_load_that_fails_half_way_leaves_the_old_version(store, table):
    store.load(small_tables(table))
    broken = table("store", [(3, "C", "New", 2001)]).withColumn("store_id", F.raise_error(F.lit("lost")).cast("int"))
    tables = small_tables(table)
    with pytest.raises(Exception, match="lost"):
        store.load(RetailTables({"customer": tables.customer, "store": broken, "purchase": tables.purchase}))
    assert store.numbers() == [1] and store.open().tables().store.count() == 3
    assert store.load(tables).number == 2


def test_of_two_writers_one_is_refused(store, table):
    base = store.load(small_tables(table))
    store.replace(base, product=table("product", [("5", "Books")]))
    with pytest.raises(VersionConflict):
        store.append_purchases(base, table("purchase", [sale(8)]))
    assert store.numbers() == [1, 2] and [r.product_id for r in store.open().table("product").collect()] == ["5"]
    assert not [name for name in os.listdir(f"{store.folder}/versions") if name.startswith("_draft")]


def test_expiry_keeps_what_a_kept_version_names(store, table):
    version = store.load(small_tables(table))
    for number in range(8, 12):
        version = store.append_purchases(version, table("purchase", [sale(number)]))
    assert store.expire(keep=2) == [1, 2, 3] and store.numbers() == [4, 5]
    assert version.table("purchase").count() == 5 and totals(store.open(4)) == {1: ("40.00", 4)}
    folders = {f"{store.folder}/data/{name}" for name in os.listdir(f"{store.folder}/data")}
    assert folders == {f for n in (4, 5) for paths in store.open(n).folders.values() for f in paths}
    with pytest.raises(LookupError):
        store.open(1)


def test_sql_reads_the_stored_statistics(spark, store, table):
    users = {name: spark.createDataFrame([], schema.TABLES[name]) for name in ("user_info",)}
    version = store.load(small_tables(table))
    tables = RetailTables({**{n: version.table(n) for n in version.folders}, **users})
    sql_surface.register(spark, tables)
    found = spark.sql("SELECT store_id, num_purchases FROM mv_store_sales_stats")
    assert [tuple(r) for r in found.collect()] == [(1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and all("/mv_store_sales_stats-" in path for path in found.inputFiles())

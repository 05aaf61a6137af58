from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillwise import schema
from tillwise.sources import mapping, staging, tables

HEADER = ",".join(schema.STAGING.names)
GOOD = (
    "1,30,50000.5,Books,25.25,2023-06-01,7,Boston,Cash,20,15.5,200,50,,Ann Lee,F,2015,3,11,21,2023-06-02,100.00,Chain"
)


def read(spark, tmp_path, lines, end="\n", **options):
    path = tmp_path / "flat.csv"
    path.write_text(end.join([HEADER, *lines]) + end, newline="")
    return staging.read_staging(spark, str(path), **options)


def test_typed_row(spark, tmp_path):
    row = read(spark, tmp_path, [GOOD]).first()
    assert (row.customer_id, row.age, row.store_location, row.qty, row.competitor_price_usd) == (1, 30, "Boston", 50, None)
    assert row.purchased_product_price_usd == Decimal("100.00")
    assert row.load_issues == []
    assert row.store_chain_name == "Chain"


def test_unreadable_fields_are_null_and_named(spark, tmp_path):
    bad = GOOD.replace("1,30,", "1,old,", 1).replace("2023-06-01", "June", 1)
    staged = read(spark, tmp_path, [GOOD, bad])
    row = staging.quarantine(staged).first()
    assert staging.quarantine(staged).count() == 1
    assert row.age is None and row.purchase_date is None
    assert row.load_issues == ["age: not a int", "purchase_date: not a date"]


def test_null_mark_empty_and_short_rows(spark, tmp_path):
    null_id = GOOD.replace("1,30,", "\\N,,", 1)
    rows = read(spark, tmp_path, [null_id, "2,40"]).orderBy(F.col("customer_id").asc_nulls_first()).collect()
    assert rows[0].customer_id is None and rows[0].age is None and rows[0].load_issues == []
    assert rows[1].age == 40 and rows[1].gender is None
    assert rows[1].load_issues == ["wrong number of fields"]


def test_lenient_values(spark, tmp_path):
    lenient = GOOD.replace("1,30,", "12abc,,", 1).replace("100.00", "123456.7")
    null_id = GOOD.replace("1,30,", "\\N,99999999999,", 1)
    first, second = read(spark, tmp_path, [lenient, null_id], mysql_coerce=True).collect()
    assert (first.customer_id, first.age) == (12, 0)
    assert first.purchased_product_price_usd == Decimal("9999.99")
    assert (second.customer_id, second.age) == (None, 2147483647)


def test_quotes_and_line_ends(spark, tmp_path):
    quoted = GOOD.replace("Ann Lee", '"Lee, Ann"')
    as_is = read(spark, tmp_path, [quoted]).first()
    assert as_is.full_name == '"Lee' and as_is.load_issues[-1] == "wrong number of fields"
    cleaned = read(spark, tmp_path, [quoted], clean=True).first()
    assert cleaned.full_name == "Lee, Ann" and cleaned.load_issues == []
    assert read(spark, tmp_path, [GOOD], end="\r\n").first().store_chain_name == "Chain\r"
    assert read(spark, tmp_path, [GOOD], end="\r\n", clean=True).first().store_chain_name == "Chain"


def test_normalise(spark, tmp_path):
    second = GOOD.replace(",11,21,", ",12,21,").replace(",3,12", ",0,12")
    no_ids = GOOD.replace("1,30", "\\N,30", 1).replace(",11,21,", ",\\N,22,")
    result = staging.normalise(read(spark, tmp_path, [GOOD, GOOD, second, no_ids]))
    assert set(result.names()) == set(list(schema.TABLES)[:7])
    counts = {name: result[name].count() for name in result.names()}
    assert counts["customer"] == 1 and counts["purchase"] == 2 and counts["store"] == 1
    assert counts["product"] == 2 and counts["inventory"] == 2 and counts["popularity"] == 1
    item = result.inventory.filter("product_id = '21'").first()
    assert item.product_price_usd == Decimal("25.25") and item.competitor_price_usd is None
    flags = {(r.customer_id, r.is_favorite) for r in result.customer_visits.collect()}
    assert flags == {(1, True), (1, False), (None, True)}


def test_missing_and_oversized_amounts(spark, tmp_path):
    missing = GOOD.replace(",25.25,", ",,").replace(",15.5,", ",123456,")
    item = staging.normalise(read(spark, tmp_path, [missing])).inventory.first()
    assert item.product_price_usd == Decimal("0.00")
    assert item.product_cost_usd is None


@pytest.mark.parametrize("name", list(schema.TABLES)[:7])
def test_flat_file_round_trip(spark, name):
    """Normalising the flat file gives back the rows it was made from."""
    folder = "/root/testdata/sf0.001"
    flat = staging.normalise(mapping.load_staging(spark, folder))[name]
    original = mapping.load_tables(spark, folder)[name]
    key = schema.KEYS[name]
    found = schema.conform(flat, name).dropna(subset=key)
    if name == "inventory":
        found = found.filter("qty IS NOT NULL")
    if name == "customer_visits":
        original = original.join(found.select(*key), key, "left_semi")
    assert found.exceptAll(original.select(*found.columns)).count() == 0
    assert found.count() > 0


def test_tables_round_trip_and_append(spark, table, tmp_path):
    product = table("product", [("1", "Books"), ("2", "Clothing")])
    tables.write_tables(tables.RetailTables({"product": product}), str(tmp_path))
    tables.append_rows(table("product", [("3", "Books")]), str(tmp_path), "product")
    stored = tables.read_tables(spark, str(tmp_path)).product
    assert stored.count() == 3
    tables.write_table(product, str(tmp_path), "product")
    assert tables.read_tables(spark, str(tmp_path)).product.count() == 2

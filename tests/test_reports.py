"""Edge cases of the reports on small tables."""

from decimal import Decimal

import pytest

from tillwise.operators import paging
from tillwise.plans import reports, sql_surface
from tillwise.sources.tables import RetailTables


@pytest.fixture
def tables(table):
    """Chain 1 sells, chain 2 has no traffic, chain 3 no sales, chain 4 only unstocked sales."""
    return RetailTables(
        {
            "store": table(
                "store",
                [(1, "A", "One", 2000), (1, "B", "Uno", 2001), (2, "A", "Two", 2002), (3, "A", "Three", 2003), (4, "A", "Four", 2004)],
            ),
            "product": table("product", [("1", "Books"), ("2", "Groceries")]),
            "customer": table(
                "customer", [(1, 20, "F", "1.00", "Ann"), (2, 95, "M", "1.00", "Bob"), (3, 50, "X", "1.00", "Cy")]
            ),
            "inventory": table(
                "inventory",
                [("1", 1, "A", 5, "30.00", "4.00", None), ("2", 1, "B", 5, "30.00", "6.00", "7.00"), ("1", 2, "A", 1, "9.00", "5.00", None)],
            ),
            "popularity": table(
                "popularity",
                [(1, "A", "2023-01-01", 10), (1, "A", "2023-01-02", 15), (1, "B", "2023-01-01", 5), (3, "A", "2023-01-01", 9), (4, "A", "2023-01-01", 9)],
            ),
            "purchase": table(
                "purchase",
                [
                    ("1", "1", 1, 1, "Cash", 50, "2023-01-01", "A", "10.00"),
                    ("2", "2", 1, 2, "Cash", 0, "2023-01-02", "B", "20.01"),
                    ("3", "1", 2, 1, "Debit Card", 0, "2023-01-03", "A", "7.00"),
                    ("4", "1", 4, 3, "Debit Card", 10, "2023-01-03", "A", "8.00"),
                    ("x", "2", 1, 1, "Credit Card", 0, "2023-01-03", "A", "1.00"),
                ],
            ),
            "customer_visits": table("customer_visits", [(1, 1, "A", True), (2, 2, "A", False), (3, 1, "B", False), (3, 2, "A", False)]),
            "user_info": table("user_info", [("ann", "A", "B", "saltsalt", None, 1)]),
        }
    )


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_store_performance_keeps_every_store(tables):
    assert rows(reports.store_performance(tables)) == {
        (1, "A", 2, Decimal("11.00"), Decimal("12.5000")),
        (1, "B", 1, Decimal("20.01"), Decimal("5.0000")),
        (2, "A", 1, Decimal("7.00"), Decimal("0.0000")),
        (3, "A", 0, Decimal("0.00"), Decimal("9.0000")),
        (4, "A", 1, Decimal("8.00"), Decimal("9.0000")),
    }


def test_store_scores(tables):
    scores = {r.store_id: r.score for r in reports.store_scores(tables).collect()}
    profit = (5.00 - 4) + (20.01 - 6)
    assert scores[1] == pytest.approx(0.5 * 3 / 30 + 0.5 * profit / 3)
    assert scores == {1: scores[1], 2: None, 3: 0.0, 4: None}


def test_profit_ignores_discount_and_unstocked_sales(tables):
    assert rows(reports.store_profit(tables)) == {
        ("One", "A", Decimal("6.00")),
        ("Uno", "B", Decimal("14.01")),
        ("Two", "A", Decimal("2.00")),
    }


def test_sales_reports(tables):
    assert rows(reports.sales_by_category_age(tables)) == {
        ("Books", "10-20", Decimal("12.00")),
        ("Books", "50-59", Decimal("7.20")),
        ("Groceries", "90+", Decimal("20.01")),
        ("Groceries", "10-20", Decimal("1.00")),
    }
    assert [tuple(r) for r in reports.sales_by_age(tables).collect()] == [
        ("90+", Decimal("20.01")),
        ("10-20", Decimal("13.00")),
        ("50-59", Decimal("7.20")),
    ]
    assert rows(reports.category_age_span(tables)) == {("Books", "10-20", "50-59"), ("Groceries", "10-20", "90+")}
    assert [tuple(r) for r in reports.needs_vs_wants(tables).collect()] == [
        ("10-20", Decimal("1.00"), Decimal("12.00")),
        ("50-59", Decimal("0.00"), Decimal("7.20")),
        ("90+", Decimal("20.01"), Decimal("0.00")),
    ]


def test_gender_reports(tables):
    assert rows(reports.gender_stats(tables)) == {
        ("F", 3, Decimal("6.00")),
        ("M", 1, Decimal("20.01")),
        ("X", 1, Decimal("8.00")),
    }
    assert rows(reports.gender_by_category(tables, "Groceries")) == {("M", 1), ("F", 1)}
    assert rows(reports.gender_by_category(tables, "groceries")) == set()
    assert rows(reports.gender_by_category(tables, "groceries", "UTF8_LCASE")) == {("M", 1), ("F", 1)}


def test_visits_count_once_per_location_and_ties_stay(tables):
    found = [tuple(r) for r in reports.top_chain_by_age_group(tables).collect()]
    assert found == [
        ("18-25", "One", 1), ("18-25", "Uno", 1), ("36-50", "One", 1), ("36-50", "Two", 1), ("36-50", "Uno", 1),
        ("90+", "Two", 1),
    ]


def test_directory_takes_the_name_of_the_first_location(spark, tables):
    assert rows(reports.chain_directory(tables)) == {(1, "One", 2), (2, "Two", 1), (3, "Three", 1), (4, "Four", 1)}
    wanted = spark.createDataFrame([(1,), (9,)], "store_id int")
    assert rows(reports.store_counts(tables, wanted)) == {(1, 2), (9, 0)}


def test_next_ids(tables, table):
    assert rows(reports.next_ids(tables)) == {(5, 3)}
    assert rows(reports.next_ids(tables.replacing(purchase=table("purchase", [])))) == {(1, None)}


def test_top_inventory_breaks_ties_by_key(tables):
    found = [tuple(r) for r in reports.top_inventory(tables, 2).collect()]
    assert found == [("1", "One", "A", Decimal("30.00")), ("2", "Uno", "B", Decimal("30.00"))]


def test_payment_usage_order(tables):
    found = [tuple(r) for r in reports.payment_usage(tables).collect()]
    assert found[0] == (1, "A", "Cash", 1) and found == sorted(found, key=lambda r: (r[0], r[1], -r[3], r[2]))


def test_pages(spark):
    df = spark.range(23).selectExpr("id div 5 AS a", "id AS b")
    assert [r.b for r in paging.page(df, ["a", "b"], 3).collect()] == [20, 21, 22]
    assert paging.page_count(df).first().pages == 3
    seen, last = [], None
    while page := [r.asDict() for r in paging.page_after(df, ["a", "b"], last).collect()]:
        seen += [r["b"] for r in page]
        last = page[-1]
    assert seen == list(range(23))


def test_sql_surface(spark, tables):
    sql_surface.register(spark, tables)
    one = spark.sql(
        "SELECT get_contact_email('jwoodwell'), store_count(1), store_count(9), store_id_to_store_chain(1),"
        " store_id_to_store_chain(9), store_score(3), get_sale_price(1, 1, 1, 1), get_sale_price(1, 1, 1, 2)"
    ).first()
    assert tuple(one) == ("jwoodwell@retail_stats.com", 2, 0, "One", None, 0.0, Decimal("5.00"), None)
    by_category = sql_surface.run(
        spark, "SELECT age_range FROM sales_summary_by_age_group WHERE product_category = :category", category="Books"
    )
    assert rows(by_category) == {("10-20",), ("50-59",)}
    assert spark.sql("SELECT * FROM mv_store_sales_stats WHERE store_id = 1").first().num_purchases == 3
    double_quoted = spark.sql('SELECT count(*) FROM store WHERE store_id = 1 AND store_location = "A"')
    assert double_quoted.first()[0] == 1


def test_sql_surface_builds_the_tables_of_a_query_only(spark, tables):
    def refuse():
        raise AssertionError("a table that the query does not name")

    some = RetailTables({**{name: refuse for name in tables.names()}, "store": tables.store})
    sql_surface.register(spark, some, ["store", "store_directory"])
    assert spark.sql("SELECT store_count(1), store_count(9) FROM store LIMIT 1").first()[:] == (2, 0)


def test_page_index_reads_the_rows_of_a_page(spark, tmp_path):
    rows = spark.range(5_003).selectExpr("id % 700 AS a", "id AS b", "'x' AS c").repartition(5)
    index = paging.PageIndex.build(rows, ["a", "b"], str(tmp_path / "pages"), ranges=6)
    expected = sorted((k % 700, k) for k in range(5_003))
    assert index.page_count() == 501
    for number in (1, 2, 37, 250, 500, 501, 502, 90_000):
        found = index.page(number)
        assert found.columns == ["a", "b", "c"]
        assert [(r.a, r.b) for r in found.collect()] == expected[(number - 1) * 10 : number * 10]
    # A page over the end of a range.
    fences = {r.page_range: r.before for r in spark.read.parquet(f"{tmp_path}/pages/fences").collect()}
    assert len(fences) > 1
    edge = sorted(fences.values())[1]
    assert [(r.a, r.b) for r in index.page(2, edge - 1).collect()] == expected[edge - 1 : 2 * (edge - 1)]
    plan = index.page(250)._jdf.queryExecution().executedPlan().toString()
    assert "page_place" in plan.split("PushedFilters: [")[1].split("]")[0] and "page_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    nothing = paging.PageIndex.build(rows.limit(0), ["a"], str(tmp_path / "none"))
    assert nothing.page_count() == 0

import pytest
from pyspark.sql import functions as F

from tillwise import schema
from tillwise.operators import cascade, quality
from tillwise.sources.tables import RetailTables

AS_OF = "2024-01-01"


def small_tables(table):
    return RetailTables(
        {
            "store": table("store", [(1, "A", "Chain", 2000), (1, "B", "Chain", 2001), (2, "A", "Other", 1999)]),
            "product": table("product", [("1", "Books"), ("2", "Clothing")]),
            "customer": table("customer", [(1, 30, "F", "10.00", "Ann"), (2, 40, "M", "10.00", "Bob")]),
            "inventory": table("inventory", [("1", 1, "A", 5, "10.00", "5.00", None), ("2", 2, "A", 5, "9.00", "5.00", None)]),
            "popularity": table("popularity", [(1, "A", "2023-01-01", 10)]),
            "purchase": table("purchase", [("7", "1", 1, 1, "Cash", 0, "2023-01-01", "A", "10.00")]),
            "customer_visits": table("customer_visits", [(1, 1, "A", True), (2, 2, "A", False)]),
        }
    )


def reasons_by(found, key):
    return {getattr(row, key): row.reasons for row in found.collect()}


def test_null_audit(spark, table):
    customers = table("customer", [(1, None, "F", "1.00", None), (2, 20, "M", "1.00", "Bob")])
    found = quality.null_audit(customers, "customer")
    assert reasons_by(found, "customer_id") == {1: ["age is missing", "full_name is missing"]}
    report = {tuple(r) for r in quality.report(found, "customer").collect()}
    assert report == {("customer", "1", "age is missing"), ("customer", "1", "full_name is missing")}


def test_key_conflicts_ignore_exact_copies(table):
    customers = table("customer", [(1, 30, "F", "1.00", "Ann")] * 3 + [(2, 20, "M", "1.00", "Bob"), (2, 21, "M", "1.00", "Bob")])
    found = quality.key_conflicts(customers, ["customer_id"])
    assert sorted((r.customer_id, r.age) for r in found.collect()) == [(2, 20), (2, 21)]


def test_orphans_skip_null_references(spark, table):
    tables = small_tables(table)
    rows = [
        ("1", "9", 1, 1, "Cash", 0, "2023-01-01", "A", "10.00"),
        ("2", "1", 1, 9, "Cash", 0, "2023-01-01", "Z", "10.00"),
        ("3", None, None, 1, "Cash", 0, "2023-01-01", "A", "10.00"),
        ("4", "1", 1, 1, "Cash", 0, "2023-01-01", "A", "10.00"),
    ]
    found = quality.table_orphans(tables.replacing(purchase=table("purchase", rows)), "purchase")
    assert reasons_by(found, "purchase_id") == {"1": ["no product"], "2": ["no store", "no customer"]}


def test_domain_audit(spark, table):
    customers = table("customer", [(1, 30, "m", "1.00", "a"), (2, 100, "MX", "1.00", "b"), (3, -1, "X", "1.00", "c" * 256)])
    found = reasons_by(quality.domain_audit(customers, "customer"), "customer_id")
    assert found == {
        1: ["gender is not listed"],
        2: ["gender is longer than 1", "gender is not listed", "age is out of range"],
        3: ["full_name is longer than 255", "age is out of range"],
    }
    wide = spark.sql("SELECT 'a' AS purchase_id, 10000.00BD AS purchased_product_price_usd")
    assert reasons_by(quality.domain_audit(wide, "purchase"), "purchase_id") == {
        "a": ["purchased_product_price_usd does not fit decimal(6,2)"]
    }
    admins = table("admin", [("x", "chef"), ("u" * 21, "engineer")])
    assert reasons_by(quality.domain_audit(admins, "admin"), "username") == {
        "x": ["employee_type is not listed"],
        "u" * 21: ["username is longer than 20"],
    }


NO_STORE = ["store_id is unknown", "store_location is unknown", "product_id is not sold there"]
GOOD = {
    "purchase_id": "8",
    "product_id": "1",
    "store_id": "1",
    "customer_id": "2",
    "payment_method": "Cash",
    "discount_percent": "10",
    "txn_date": "2023-05-05",
    "store_location": " A ",
    "purchased_product_price_usd": "100",
}


def check(spark, tables, *changed):
    names = schema.TABLES["purchase"].names
    rows = [tuple({**GOOD, "purchase_id": str(100 + i), **change}[n] for n in names) for i, change in enumerate(changed)]
    candidates = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return quality.check_purchases(candidates, tables, F.lit(AS_OF).cast("date"))


def test_purchase_rules(spark, table):
    cases = {
        "good": ({}, []),
        "text id": ({"purchase_id": "P1"}, ["purchase_id is not a number"]),
        "long id": ({"purchase_id": "10000000"}, ["purchase_id has more than 7 digits"]),
        "endless id": ({"purchase_id": "9" * 30}, ["purchase_id has more than 7 digits"]),
        "taken": ({"purchase_id": "007"}, ["purchase_id is taken"]),
        "customer": ({"customer_id": "9"}, ["customer_id is unknown"]),
        "no customer": ({"customer_id": None}, ["customer_id is not a number"]),
        "endless customer": ({"customer_id": "9" * 25}, ["customer_id is unknown"]),
        "store": ({"store_id": "9"}, NO_STORE),
        "endless store": ({"store_id": "9" * 25}, NO_STORE),
        "endless store elsewhere": ({"store_id": "9" * 25, "store_location": "Z"}, NO_STORE),
        "location": ({"store_location": "Z"}, NO_STORE[1:]),
        "item": ({"product_id": "2"}, ["product_id is not sold there"]),
        "price": ({"purchased_product_price_usd": "100000"}, ["price is 100000 or more"]),
        "price width": ({"purchased_product_price_usd": "10000"}, ["price does not fit decimal(6,2)"]),
        "price text": ({"purchased_product_price_usd": "9.99"}, ["purchased_product_price_usd is not a number"]),
        "discount": ({"discount_percent": "101"}, ["discount_percent is over 100"]),
        "payment": ({"payment_method": "Mobile Payment"}, ["payment_method is not accepted"]),
        "date": ({"txn_date": "2023-02-30"}, ["txn_date is not a date"]),
        "future": ({"txn_date": "2024-01-02"}, ["txn_date is in the future"]),
    }
    checked = check(spark, small_tables(table), *[change for change, _ in cases.values()])
    got = reasons_by(checked, "purchase_id")
    for i, (name, (change, expected)) in enumerate(cases.items()):
        assert got[change.get("purchase_id", str(100 + i))] == expected, name
    accepted = quality.accepted_purchases(checked).collect()
    assert [(r.purchase_id, r.store_location, r.txn_date.isoformat()) for r in accepted] == [("100", "A", "2023-05-05")]


def test_repeated_ids_in_a_batch(spark, table):
    copies = check(spark, small_tables(table), {"purchase_id": "8"}, {"purchase_id": "8"})
    assert [r.reasons for r in copies.collect()] == [[]]
    different = check(spark, small_tables(table), {"purchase_id": "8"}, {"purchase_id": "8", "customer_id": "1"})
    assert [r.reasons for r in different.collect()] == [["purchase_id is repeated"]] * 2
    refused = {"purchase_id": "8", "customer_id": "9"}
    one_valid = check(spark, small_tables(table), {"purchase_id": "8"}, refused, refused)
    assert sorted(r.reasons for r in one_valid.collect()) == [[], ["customer_id is unknown"], ["customer_id is unknown"]]


def test_cascade_delete(table):
    tables = small_tables(table)
    gone = cascade.delete(tables, "store", tables.store.filter("store_id = 1 AND store_location = 'A'").select("store_id", "store_location"))
    counts = {name: gone[name].count() for name in gone.names()}
    assert counts == {
        "store": 2, "product": 2, "customer": 2, "inventory": 1, "popularity": 0, "purchase": 0, "customer_visits": 1,
    }
    no_customer = cascade.delete(tables, "customer", tables.customer.filter("customer_id = 2").select("customer_id"))
    assert no_customer.customer_visits.count() == 1 and no_customer.purchase.count() == 1


def test_rename_conflicts_are_reported(spark, table):
    tables = small_tables(table).replacing(customer=table("customer", [(k, 30, "M", "1.00", "n") for k in range(1, 6)]))
    renamed = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 20), (4, 5), (5, 50)], "customer_id long, new_customer_id long")
    renamed = renamed.filter("customer_id <> 5")
    found = cascade.update_conflicts(tables, "customer", renamed)
    assert sorted((r.customer_id, r.new_customer_id, r.reason) for r in found.collect()) == [
        (1, 10, "key is renamed twice"),
        (1, 11, "key is renamed twice"),
        (2, 20, "new key is given twice"),
        (3, 20, "new key is given twice"),
        (4, 5, "new key is taken"),
    ]


def test_cascade_update(spark, table):
    renamed = spark.createDataFrame([(1, "A", 5, "AA")], "store_id int, store_location string, new_store_id int, new_store_location string")
    moved = cascade.update(small_tables(table), "store", renamed)
    assert {(r.store_id, r.store_location) for r in moved.store.collect()} == {(5, "AA"), (1, "B"), (2, "A")}
    assert {(r.store_id, r.store_location) for r in moved.inventory.collect()} == {(5, "AA"), (2, "A")}
    assert moved.purchase.first().store_id == 5 and moved.popularity.first().store_location == "AA"
    assert quality.table_orphans(moved, "purchase").count() == 0


def test_cascade_update_merges_into_a_key_that_stays(spark, table):
    columns = "store_id int, store_location string, new_store_id int, new_store_location string"
    tables = small_tables(table)
    taken = spark.createDataFrame([(1, "A", 2, "A")], columns)
    years = {(r.store_id, r.store_location): r.year_opened for r in tables.store.collect()}
    merged = cascade.update(tables, "store", taken, merge=True)
    assert {(r.store_id, r.store_location): r.year_opened for r in merged.store.collect()} == {
        key: year for key, year in years.items() if key != (1, "A")
    }
    assert merged.purchase.count() == tables.purchase.count() and merged.purchase.filter("store_id = 1 AND store_location = 'A'").count() == 0
    assert quality.table_orphans(merged, "purchase").count() == 0
    twice = spark.createDataFrame([(1, "A", 2, "A"), (1, "A", 6, "AA")], columns)
    with pytest.raises(cascade.KeyConflict, match="renamed twice"):
        cascade.update(tables, "store", twice, merge=True)


def test_cascade_update_refuses_conflicts(spark, table):
    columns = "store_id int, store_location string, new_store_id int, new_store_location string"
    twice = spark.createDataFrame([(1, "A", 5, "AA"), (1, "A", 6, "AA")], columns)
    with pytest.raises(cascade.KeyConflict, match="renamed twice"):
        cascade.update(small_tables(table), "store", twice)
    taken = spark.createDataFrame([(1, "A", 2, "A")], columns)
    with pytest.raises(cascade.KeyConflict, match="taken"):
        cascade.update(small_tables(table), "store", taken)
    # The same row twice is one renaming.
    same = spark.createDataFrame([(1, "A", 5, "AA")] * 2, columns)
    assert cascade.update(small_tables(table), "store", same).store.count() == 3


def test_user_rules(spark, table):
    taken = table("user_info", [("ann", "A", "B", "saltsalt", None, 0)])
    columns = "username string, secret string, is_admin int, first_name string, last_name string, is_store_manager string, phone_number string, employee_type string"
    rows = [
        ("bob", "pw", 0, "B", "C", "1", "+1 (555) 1-2", None),
        ("ann", "pw", 1, "B", "C", None, None, "Engineer"),
        ("a b", "", 0, "", "C", "2", "call", None),
        ("x-y", "p w", 1, "B", None, None, None, "chef"),
        ("", "pw", 0, "B", "C", "0", "1" * 21, None),
    ]
    got = reasons_by(quality.check_users(spark.createDataFrame(rows, columns), taken), "username")
    assert got == {
        "bob": [],
        "ann": ["username is taken"],
        "a b": [
            "username has a space", "secret is missing", "first_name is missing",
            "is_store_manager is not 0 or 1", "phone_number has other characters",
        ],
        "x-y": ["username has other characters", "secret has a space", "last_name is missing", "employee_type is not listed"],
        "": ["username is missing", "phone_number is longer than 20"],
    }
    logins = spark.createDataFrame([("ann", "pw"), ("zoe", "pw")], "username string, secret string")
    assert reasons_by(quality.check_logins(logins, taken), "username") == {"ann": [], "zoe": ["username is unknown"]}


def test_candidates_in_shares_are_found_to_be_the_same(spark, table, monkeypatch):
    text = "purchase_id string, product_id string, store_id string, customer_id string, payment_method string, " + (
        "discount_percent string, txn_date string, store_location string, purchased_product_price_usd string"
    )
    good = ("1", "1", "1", "Cash", "5", "2023-05-05", "A", "10")
    rows = [(str(k), *good) for k in range(1, 41)] + [("8", *good), (" 9 ", *good), (None, *good), ("x", *good), ("x", *good)]
    rows += [("10", "1", "1", "1", "Cash", "6", "2023-05-05", "A", "10"), ("7", "1", "3", "9", "Cash", "5", "2023-05-05", "A", "10")]
    candidates, tables, folders = spark.createDataFrame(rows, text), small_tables(table), []
    new_folder = quality.session.new_folder
    monkeypatch.setattr(quality.session, "new_folder", lambda s, p: folders.append((p, new_folder(s, p))) or folders[-1][1])
    today = F.lit(AS_OF).cast("date")

    def found(share_rows, taken=None):
        checked = quality.check_purchases(candidates, tables, today, 7, taken, share_rows).collect()
        return sorted([(*row[:-1], tuple(row[-1])) for row in checked], key=str)

    whole = found(1_000)
    folders.clear()
    assert found(10) == whole and len(whole) == 46
    by_index = lambda wanted: wanted.filter("number = 7").distinct()
    assert found(10, by_index) == whole
    at = dict(folders)
    assert len(quality.session.listing(spark, at["checked-purchases"])) == 8
    assert not quality.session.exists(spark, at["entered-purchases"])

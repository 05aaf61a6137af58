"""The four stated users, their logins, and the two changed secrets."""

from tillwise.operators import users

REQUEST = "arrival int, username string, secret string, is_admin int, first_name string, last_name string, is_store_manager int, phone_number string, employee_type string"
REQUESTS = [
    (1, "admin_username_engineer_john", "securepass", 1, "John", "Doe", None, None, "engineer"),
    (2, "jsmith", "clientpass", 0, "Jane", "Smith", 1, "123-456-7890", None),
    (3, "cbrown", "snoopy", 0, "Charlie", "Brown", 0, "111-222-3333", None),
    (4, "jwoodwell", "securepass_woodwell", 1, "James", "Woodwell", None, None, "engineer"),
]


def add(spark, rows, existing=None):
    empty = spark.createDataFrame([], "username string")
    return users.add_users(spark.createDataFrame(rows, REQUEST), existing if existing is not None else empty, "key")


def attempts(spark, user_info, *pairs):
    checked = users.check_digests(spark.createDataFrame(pairs, "username string, secret string"), user_info)
    results = {(r.username, r.secret): r.result for r in checked.collect()}
    return [results[pair] for pair in pairs]


def test_logins_before_and_after_changes(spark):
    added = add(spark, REQUESTS)
    assert {r.username for r in added.admin.collect()} == {"admin_username_engineer_john", "jwoodwell"}
    assert {(r.username, r.is_store_manager) for r in added.client.collect()} == {("jsmith", 1), ("cbrown", 0)}
    assert attempts(
        spark,
        added.user_info,
        ("chaka", "hello"),
        ("alex", "goodbye"),
        ("admin_username_engineer_john", "securepass"),
        ("alex", "HELLO"),
        ("jsmith", "clientpass"),
        ("jsmith", "clientpasswrong"),
        ("cbrown", "snoopy"),
    ) == [0, 0, 2, 0, 1, 0, 1]

    changes = spark.createDataFrame(
        [("cbrown", "ignored", 1), ("cbrown", "snoopydoopy", 2), ("jwoodwell", "1234567", 3), ("nobody", "x", 4)],
        "username string, secret string, arrival int",
    )
    rotated = users.rotate_digests(added.user_info, changes, "key")
    assert rotated.count() == 4
    assert attempts(
        spark,
        rotated,
        ("cbrown", "snoopy"),
        ("cbrown", "snoopydoopy"),
        ("jwoodwell", "securepass_woodwell"),
        ("jwoodwell", "1234567"),
        ("jsmith", "clientpass"),
    ) == [0, 1, 0, 2, 1]


def test_first_of_repeated_names_wins_and_present_names_are_skipped(spark):
    again = [(5, "jsmith", "other", 1, "Late", "Comer", None, None, "engineer")]
    added = add(spark, REQUESTS + again)
    assert added.user_info.filter("username = 'jsmith'").first().first_name == "Jane"
    assert added.admin.count() == 2
    assert add(spark, REQUESTS, added.user_info).user_info.count() == 0


def test_a_digest_held_twice_is_refused(spark):
    info = add(spark, REQUESTS[1:2]).user_info
    twin = info.selectExpr("'twin' AS username", "first_name", "last_name", "salt", "password_hash", "is_admin")
    assert attempts(spark, info.unionByName(twin), ("jsmith", "clientpass")) == [0]


def test_public_columns(spark):
    assert users.public_users(add(spark, REQUESTS).user_info).columns == ["username", "first_name", "last_name", "is_admin"]


def test_names_in_any_case_under_a_collation(spark):
    rows = [(2, "Bob", "b", 0, "B", "B", 0, "1", None), (1, "bob", "a", 0, "A", "A", 0, "1", None), (3, "ANN", "c", 0, "C", "C", 0, "1", None)]
    present = spark.createDataFrame([("Ann",)], "username string")
    requests = spark.createDataFrame(rows, REQUEST)
    assert {r.username for r in users.add_users(requests, present, "key").user_info.collect()} == {"Bob", "bob", "ANN"}
    added = users.add_users(requests, present, "key", "UTF8_LCASE").user_info
    assert [(r.username, r.first_name) for r in added.collect()] == [("bob", "A")]
    asked = spark.createDataFrame([("BOB", "a"), ("bob", "A"), ("bob", "a")], "username string, secret string")
    for collation, expected in ((None, [0, 0, 1]), ("UTF8_LCASE", [1, 0, 1])):
        results = {(r.username, r.secret): r.result for r in users.check_digests(asked, added, collation).collect()}
        assert [results[pair] for pair in [("BOB", "a"), ("bob", "A"), ("bob", "a")]] == expected

"""Queries of the operators that SQL can express against their SQL, on the smallest data."""

import pytest

from checks import compare
from tests.conftest import SMALL
from tillwise.llm import registry


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_equal(spark, connection, name):
    result = registry.queries()[name](spark, SMALL)
    rows = compare.rows_of(result.columns, result.collect())
    assert compare.difference(result.columns, rows, connection, registry.oracle_sql()[name]) == ""


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.queries() if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in registry.queries()

"""Every registered query against its SQL in DuckDB on the smallest data."""

import pytest

import __spark_entry__ as registered
from checks import compare, oracle
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SMALL)


def test_every_query_has_sql():
    assert set(registered._QUERIES) == set(oracle.oracles())


def test_entry(spark):
    assert registered.entry(spark).count() == 10


@pytest.mark.parametrize("name", list(oracle.oracles()))
def test_equal(spark, connection, name):
    assert compare.compare(spark, connection, name, SMALL) == ""

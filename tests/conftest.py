import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillwise import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session.build_session(
        "local[8]",
        4,
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def table(spark):
    """Rows in the layout of a retail table; dates and amounts may be text."""
    from tillwise import schema

    def build(name, rows):
        fields = schema.TABLES[name].fields
        text = ", ".join(f"{f.name} string" for f in fields)
        plain = [tuple(None if value is None else str(value) for value in row) for row in rows]
        return schema.conform(spark.createDataFrame(plain, text), name)

    return build

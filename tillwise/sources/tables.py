"""A set of retail tables, each built on first use."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tillwise import schema


class RetailTables:
    """Named DataFrames: ``tables.purchase``, ``tables["store"]``.

    A table may be given as a DataFrame or as a function that builds it, so that a job
    touching one table plans no other.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._tables = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        return self[name]

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def names(self) -> list[str]:
        return list(self._tables)

    def replacing(self, **tables: DataFrame) -> RetailTables:
        return RetailTables({**self._tables, **tables})


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> RetailTables:
    """Tables written by :func:`write_tables`, with their declared schemas (never inferred)."""
    chosen = names if names is not None else list(schema.TABLES)
    return RetailTables({name: _reader(spark, folder, name) for name in chosen})


def _reader(spark: SparkSession, folder: str, name: str) -> Callable[[], DataFrame]:
    return lambda: spark.read.schema(schema.TABLES[name]).parquet(f"{folder}/{name}")


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Replace one table with ``df`` cast to the declared columns."""
    schema.conform(df, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_tables(tables: RetailTables, folder: str) -> None:
    for name in tables.names():
        write_table(tables[name], folder, name)


def append_rows(df: DataFrame, folder: str, name: str) -> None:
    schema.conform(df, name).write.mode("append").parquet(f"{folder}/{name}")

"""Helpers for operators that read whole rows in Python: neutral column names and text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def named(column: str) -> Column:
    return F.col(f"`{column}`")


def neutral(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The columns as c0, c1 and so on, so that no name of the caller meets one of an operator."""
    return df.select(*[named(column).alias(f"c{i}") for i, column in enumerate(columns)])


def restored(columns: Iterable[str]) -> list[Column]:
    return [F.col(f"c{i}").alias(column) for i, column in enumerate(columns)]


def ddl(df: DataFrame, added: str) -> str:
    """Schema text of ``df`` followed by the added columns."""
    own = [f"{field.name} {field.dataType.simpleString()}" for field in df.schema.fields]
    return ", ".join([*own, added])


# Rows of a batch that are Python objects at a time.
ROWS_AT_ONCE = 256


def values(column: pa.Array) -> Iterator:
    """The values of a column, some hundred at a time as Python objects."""
    for first in range(0, len(column), ROWS_AT_ONCE):
        yield from column.slice(first, ROWS_AT_ONCE).to_pylist()


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """Texts as UTF-8 bytes, without decoding them."""
    return values(column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()))


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, work: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df`` in batches through ``work``.

    A task ends by giving its freed memory back: Spark keeps idle workers, and each would
    hold the most that any task before has taken.
    """

    def task(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


_kept: dict[str, tuple[object, object]] = {}


def kept_between_tasks(name: str, value: object, make: Callable[[object], object]) -> object:
    """What is made of a broadcast value, kept while a Python worker goes on with the same value."""
    if name not in _kept or _kept[name][0] is not value:
        _kept[name] = (value, make(value))
    return _kept[name][1]

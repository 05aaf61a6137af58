"""Removing or renaming a key together with the rows that refer to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise import schema, session
from tillwise.sources.tables import RetailTables

NEW = "new_"
SHOWN_CONFLICTS = 5
TAKEN = "new key is taken"


class KeyConflict(Exception):
    """Keys that cannot be renamed together."""


def _affected(tables: RetailTables, parent: str) -> list[tuple[str, list[str]]]:
    """The table and its children, with the columns that hold its key."""
    children = [(ref.child, list(ref.columns)) for ref in schema.REFERENCES if ref.parent == parent]
    return [(name, columns) for name, columns in [(parent, schema.KEYS[parent]), *children] if name in tables]


def delete(tables: RetailTables, parent: str, removed: DataFrame) -> RetailTables:
    """Tables without the removed keys of ``parent`` and without the rows that refer to them."""
    kept = {
        name: tables[name].join(removed, columns, "left_anti") for name, columns in _affected(tables, parent)
    }
    return tables.replacing(**kept)


def update(tables: RetailTables, parent: str, renamed: DataFrame, merge: bool = False) -> RetailTables:
    """Tables with keys of ``parent`` replaced everywhere.

    ``renamed`` has the key columns and each new value as ``new_<column>``. Where
    :func:`update_conflicts` finds any conflict nothing is renamed: a ``KeyConflict`` names
    the first ones. With ``merge`` a new key may be that of a row which keeps its own: the rows
    that refer to either then refer to that one, which stays as it is, and the renamed row of
    ``parent`` goes.
    """
    key = schema.KEYS[parent]
    renamed = session.stored(renamed.select(*key, *[NEW + c for c in key]).distinct(), "renamed-keys")
    conflicts = update_conflicts(tables, parent, renamed)
    refused = (conflicts.filter(F.col("reason") != TAKEN) if merge else conflicts).take(SHOWN_CONFLICTS)
    if refused:
        raise KeyConflict("; ".join(f"{row.asDict()}" for row in refused))
    if merge:
        merged = session.stored(conflicts.filter(F.col("reason") == TAKEN).select(*key), "merged-keys")
        tables = tables.replacing(**{parent: tables[parent].join(merged, key, "left_anti")})
    replaced = {}
    for name, columns in _affected(tables, parent):
        table = tables[name]
        new_values = {c: F.coalesce(F.col(NEW + c), F.col(c)).cast(table.schema[c].dataType) for c in columns}
        replaced[name] = table.join(renamed, columns, "left").withColumns(new_values).select(*table.columns)
    return tables.replacing(**replaced)


def update_conflicts(tables: RetailTables, parent: str, renamed: DataFrame) -> DataFrame:
    """Rows of ``renamed`` that :func:`update` must not be given, with a ``reason``.

    A key may be renamed once, two keys may not get one new key, and a new key may not be
    that of a row that keeps its own.
    """
    key = schema.KEYS[parent]
    new = [NEW + c for c in key]
    repeated = renamed.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    shared = renamed.groupBy(*new).agg(F.count("*").alias("n")).filter("n > 1").select(*new)
    staying = tables[parent].select(*key).join(renamed.select(*key), key, "left_anti")
    taken = staying.select(*[F.col(c).alias(NEW + c) for c in key])
    found = [
        ("key is renamed twice", renamed.join(repeated, key, "left_semi")),
        ("new key is given twice", renamed.join(shared, new, "left_semi")),
        (TAKEN, renamed.join(taken, new, "left_semi")),
    ]
    conflicts = [rows.select(*key, *new, F.lit(reason).alias("reason")) for reason, rows in found]
    return conflicts[0].unionByName(conflicts[1]).unionByName(conflicts[2])

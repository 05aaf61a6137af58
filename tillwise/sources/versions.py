"""Tables in versions: every load or refresh is a new version, made visible by one file.

A version is a manifest, a small file that names the folder of each table. Its number is its
place: the manifest is written beside its place and renamed, which fails if another writer
was there first, so the largest number is the current version and readers never see half of
one. A reader stays with the manifest it opened. A new version names the old folders of
tables that did not change. :meth:`VersionedTables.expire` drops old manifests first, then the
folders that no manifest left names.

Defined cases: a load that fails leaves its files, and no version; a refresh of a version that
is not the current one any more is refused; an empty store has no version to open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillwise import schema, session
from tillwise.operators import statistics
from tillwise.sources.tables import RetailTables

STATS = statistics.STORED
# Mergeable statistics, from which the stored table is made.
STATS_PARTS = "store_sales_parts"
DIGITS = 12


class VersionConflict(Exception):
    """Another writer has made the next version first."""


@dataclass(frozen=True)
class Version:
    """A version as it was opened."""

    spark: SparkSession
    number: int
    folders: Mapping[str, tuple[str, ...]]

    def table(self, name: str) -> DataFrame:
        """A table; one that was appended to has several folders."""
        declared = schema.TABLES.get(name)
        reader = self.spark.read.schema(declared) if declared is not None else self.spark.read
        return reader.parquet(*self.folders[name])

    def tables(self) -> RetailTables:
        """All tables of the version, each read on first use."""
        return RetailTables({name: self._reader(name) for name in self.folders})

    def _reader(self, name: str) -> Callable[[], DataFrame]:
        return lambda: self.table(name)


@dataclass(frozen=True)
class VersionedTables:
    spark: SparkSession
    folder: str

    def numbers(self) -> list[int]:
        """The versions that can be opened."""
        if not session.exists(self.spark, f"{self.folder}/versions"):
            return []
        names = [name for name, *_ in session.listing(self.spark, f"{self.folder}/versions")]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))

    def open(self, number: int | None = None) -> Version:
        """A version, the current one by default."""
        known = self.numbers()
        if not known or number is not None and number not in known:
            raise LookupError(f"no version {'' if number is None else number} in {self.folder}")
        chosen = known[-1] if number is None else number
        text = self.spark.read.text(self._manifest(chosen), wholetext=True).first()[0]
        return Version(self.spark, chosen, {name: tuple(folders) for name, folders in json.loads(text).items()})

    def load(self, tables: RetailTables) -> Version:
        """A version of these tables alone, with the statistics of the sales if there are any."""
        before = self.numbers()
        folders = {name: [self._write(schema.conform(tables[name], name), name)] for name in tables.names()}
        if "purchase" in tables:
            folders |= self._statistics(statistics.parts(self.spark.read.parquet(*folders["purchase"])))
        return self._publish(before[-1] + 1 if before else 1, folders)

    def replace(self, base: Version, **tables: DataFrame) -> Version:
        """The version after ``base`` with some tables replaced."""
        new = {name: [self._write(schema.conform(df, name), name)] for name, df in tables.items()}
        return self._publish(base.number + 1, {**base.folders, **new})

    def append_purchases(self, base: Version, sales: DataFrame) -> Version:
        """The version after ``base`` with more sales, and statistics that count them.

        Only the new sales and the stored statistics are read.
        """
        added = self._write(schema.conform(sales, "purchase"), "purchase")
        delta = statistics.parts(self.spark.read.schema(schema.TABLES["purchase"]).parquet(added))
        folders = {**base.folders, "purchase": [*base.folders["purchase"], added]}
        merged = statistics.merge(base.table(STATS_PARTS), delta)
        return self._publish(base.number + 1, {**folders, **self._statistics(merged)})

    def expire(self, keep: int = 2) -> list[int]:
        """Drop all but the last versions and what only they name; returns the dropped ones."""
        known = self.numbers()
        dropped, kept = known[: max(len(known) - keep, 0)], known[max(len(known) - keep, 0) :]
        named = {folder for n in kept for folders in self.open(n).folders.values() for folder in folders}
        unused = {folder for n in dropped for folders in self.open(n).folders.values() for folder in folders} - named
        for number in dropped:
            session.remove(self.spark, self._manifest(number))
        for folder in unused:
            session.remove(self.spark, folder)
        return dropped

    def _statistics(self, parts: DataFrame) -> dict[str, list[str]]:
        stored = self._write(parts, STATS_PARTS)
        finished = schema.conform(statistics.finish(self.spark.read.parquet(stored)), STATS)
        return {STATS_PARTS: [stored], STATS: [self._write(finished, STATS)]}

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/versions/{number:0{DIGITS}d}.json"

    def _publish(self, number: int, folders: Mapping[str, list[str] | tuple[str, ...]]) -> Version:
        text = json.dumps({name: list(paths) for name, paths in folders.items()})
        if not session.create_file(self.spark, self._manifest(number), text):
            raise VersionConflict(f"version {number} of {self.folder} exists")
        return self.open(number)

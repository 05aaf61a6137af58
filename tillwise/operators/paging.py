"""Pages of a report in a stated order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows per page.
PAGE_SIZE = 10


def page(df: DataFrame, order: list[str], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1). Early pages are a top-k per task, never a full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, order: list[str], last: dict | None, size: int = PAGE_SIZE) -> DataFrame:
    """The page after the row whose order columns (unique, not NULL) are ``last``.

    Deep pages cost the same as the first: the filter reaches the scan and only one page
    of rows is kept per task.
    """
    later = df
    if last is not None:
        later = df.filter(F.col(order[0]) >= F.lit(last[order[0]])).filter(_after(order, last))
    return later.orderBy(*order).limit(size)


def _after(order: list[str], last: dict) -> Column:
    condition = F.lit(False)
    for name in reversed(order):
        value = F.lit(last[name])
        condition = (F.col(name) > value) | ((F.col(name) == value) & condition)
    return condition


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """One row with the number of pages."""
    return df.agg(F.ceil(F.count("*") / size).alias("pages"))


@dataclass(frozen=True)
class PageIndex:
    """A report stored in order, so that a page by number reads the rows of that page.

    The report is sorted into ranges; ``fences`` holds the number of rows before each range and each
    row its place in its range. A page is found from the fences (a row per range) and read by
    a filter on range and place that reaches the scan, whatever its number. Rows that agree
    in all order columns keep one order while the index stands; an empty report has no pages.
    """

    spark: SparkSession
    folder: str
    order: tuple[str, ...]

    @classmethod
    def build(cls, df: DataFrame, order: list[str], folder: str, ranges: int | None = None) -> PageIndex:
        """Store a report; without a number of ranges Spark chooses it by size."""
        by = [*([] if ranges is None else [ranges]), *order]
        index = cls(df.sparkSession, folder, tuple(order))
        df.repartitionByRange(*by).withColumn(RANGE, F.spark_partition_id()).write.parquet(f"{folder}/ranges")
        stored = df.sparkSession.read.parquet(f"{folder}/ranges")
        in_range = Window.partitionBy(RANGE).orderBy(*order)
        placed = stored.withColumn(PLACE, F.row_number().over(in_range))
        placed.write.partitionBy(RANGE).parquet(f"{folder}/rows")
        earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        sizes = stored.groupBy(RANGE).agg(F.count("*").alias("rows"))
        fences = sizes.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        fences.coalesce(1).write.parquet(f"{folder}/fences")
        return index

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """Page ``number`` (from 1); behind the last page there are no rows."""
        first, last = (number - 1) * size + 1, number * size
        fences = self.spark.read.parquet(f"{self.folder}/fences")
        met = fences.filter((F.col("before") < last) & (F.col("before") + F.col("rows") >= first)).collect()
        rows = self.spark.read.parquet(f"{self.folder}/rows")
        wanted = F.lit(False)
        for fence in met:
            inside = F.col(PLACE).between(first - fence["before"], last - fence["before"])
            wanted = wanted | ((F.col(RANGE) == fence[RANGE]) & inside)
        return rows.filter(wanted).orderBy(RANGE, PLACE).drop(RANGE, PLACE)

    def page_count(self, size: int = PAGE_SIZE) -> int:
        rows = self.spark.read.parquet(f"{self.folder}/fences").agg(F.sum("rows")).first()[0]
        return -(-(rows or 0) // size)


RANGE, PLACE = "page_range", "page_place"

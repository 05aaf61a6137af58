"""Age labels. The first matching band wins; unmatched and NULL ages get the last label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label bands of the sales view (age 20 belongs to the first band naming it).
AGE_RANGES = [
    ("0-9", 0, 9),
    ("10-20", 10, 20),
    ("20-29", 20, 29),
    ("30-39", 30, 39),
    ("40-49", 40, 49),
    ("50-59", 50, 59),
    ("60-69", 60, 69),
    ("70-79", 70, 79),
    ("80-89", 80, 89),
]

# Label bands of the visits report (40-49 is shadowed by 36-50).
AGE_GROUPS = [
    ("18-25", 18, 25),
    ("26-35", 26, 35),
    ("36-50", 36, 50),
    ("40-49", 40, 49),
    ("50-59", 50, 59),
    ("60-69", 60, 69),
    ("70-79", 70, 79),
    ("80-89", 80, 89),
]

OTHER_AGES = "90+"


def _label(age: Column, bands: list[tuple[str, int, int]]) -> Column:
    def add(chain: Column | None, band: tuple[str, int, int]) -> Column:
        label, low, high = band
        inside = age.between(low, high)
        return F.when(inside, label) if chain is None else chain.when(inside, label)

    return reduce(add, bands, None).otherwise(OTHER_AGES)


def age_range(age: Column) -> Column:
    """Label used by the sales view."""
    return _label(age, AGE_RANGES)


def age_group(age: Column) -> Column:
    """Label used by the visits report; minors also fall into the last label."""
    return _label(age, AGE_GROUPS)

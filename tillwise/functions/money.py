"""Prices and exact averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE_PERCENT = "0.01"


def sale_price(price: Column, discount_percent: Column) -> Column:
    """Price after discount, rounded half up to cents: ``decimal(10,2)``.

    ``price * (100 - d) * 0.01`` stays in exact decimals; dividing by an integer 100
    would turn the product into a double.
    """
    hundredth = F.lit(ONE_PERCENT).cast("decimal(2,2)")
    return (price * (F.lit(100) - discount_percent) * hundredth).cast("decimal(10,2)")


def total(amount: Column) -> Column:
    """Sum of an amount of up to ``decimal(12,2)``, the widest declared price."""
    return F.sum(amount.cast("decimal(12,2)"))


def divided(units: Column, count: Column) -> Column:
    """``units / count`` as a whole number, half away from zero; a zero count gives NULL."""
    n = F.nullif(count, F.lit(0))
    size = F.call_function("div", F.abs(units) * 2 + n, n * 2)
    return F.when(units < 0, -size).otherwise(size)


def exact_average(total_units: Column, count: Column, scale: int) -> Column:
    """``total_units / count`` as ``decimal(20, scale)``, half away from zero, without a double.

    ``total_units`` is an integer count of ``10**-scale`` units; a zero count gives NULL.
    """
    average = divided(total_units.cast("decimal(28,0)"), count.cast("decimal(20,0)"))
    unit = F.lit("0." + "0" * (scale - 1) + "1").cast(f"decimal({scale},{scale})")
    return (average * unit).cast(f"decimal(20,{scale})")


def whole_units(amount_sum: Column, scale: int) -> Column:
    """A decimal sum as an integer count of ``10**-scale`` units."""
    return (amount_sum * 10**scale).cast("decimal(28,0)")

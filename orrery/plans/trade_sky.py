"""Positions for the sky queries from the rows of a given table: each supplier's trades of a day stand for a body, their price for its place.

The test tables hold no ephemeris. The operators take any provider's rows, and
these are rows of lineitem, read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BODIES = ["Sun", "Moon", "Mars", "Mercury", "Jupiter", "Venus", "Saturn", "Rahu"]
TIMES = ["09:15", "12:30", "14:45", "15:30"]
#: Hundred-thousandths of a degree in a circle, and the cents of price that make one.
CIRCLE = 36_000_000


def _cents() -> Column:
    return F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))


def _named(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(number, F.lit(len(names))) + 1).cast("int"))


def raw_positions(trades: DataFrame) -> DataFrame:
    """(date, planet, longitude, speed): a longitude for each body and day with trades, the speed from the body's day before, 0 on its first."""
    each = trades.groupBy(F.col("l_shipdate").cast("date").alias("date"), _named(BODIES, F.col("l_suppkey")).alias("planet")).agg(_cents().alias("cents"))
    each = each.select("date", "planet", (F.pmod("cents", F.lit(CIRCLE)).cast("double") / 100_000).alias("longitude"))
    moved = F.col("longitude") - F.lag("longitude").over(Window.partitionBy("planet").orderBy("date"))
    return each.withColumn("speed", F.coalesce(moved - 360 * F.floor((moved + 180) / 360), F.lit(0.0)))


def raw_moon(trades: DataFrame) -> DataFrame:
    """(date, time_ist, longitude, speed) from the lines of an order, four times a day."""
    each = trades.groupBy(F.col("l_shipdate").cast("date").alias("date"), _named(TIMES, F.col("l_linenumber")).alias("time_ist")).agg(_cents().alias("cents"))
    return each.select("date", "time_ist", (F.pmod("cents", F.lit(CIRCLE)).cast("double") / 100_000).alias("longitude"), (F.pmod("cents", F.lit(1500)).cast("double") / 100).alias("speed"))

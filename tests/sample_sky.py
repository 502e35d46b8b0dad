"""A synthetic sky for tests that need orbits: circular, in one plane, in plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Public mean elements at 2000-01-01 12:00: mean longitude, degrees a day, distance to the Sun (earth's is 1).
BODIES = [
    ("Sun", 280.460, 0.9856474, 0.0), ("Moon", 218.316, 13.176396, 0.0), ("Mars", 355.433, 0.5240208, 1.523688), ("Mercury", 252.251, 4.0923344, 0.387098),
    ("Jupiter", 34.351, 0.0830853, 5.202560), ("Venus", 181.980, 1.6021305, 0.723330), ("Saturn", 50.077, 0.0334442, 9.554747), ("Rahu", 125.045, -0.0529538, 0.0),
]
AYANAMSA = 24.0
#: Label of each intraday time and its hour, UTC.
TIMES = [("09:15", 3.75), ("12:30", 7.0), ("14:45", 9.25), ("15:30", 10.0)]
DAILY_HOUR = 5.5


def longitude_sql(d: str) -> str:
    """Synthetic sidereal longitude (circular orbits in one plane) of columns (l0, rate, r) at d days; the same in Spark and other SQL."""
    turn = lambda x: f"({x} - 360 * floor(({x}) / 360))"
    own, earth = f"radians(l0 + rate * {d})", f"radians(100.460 + 0.9856474 * {d})"
    seen = f"degrees(atan2(r * sin({own}) - sin({earth}), r * cos({own}) - cos({earth})))"
    return f"(CASE WHEN r = 0 THEN {turn(f'l0 + rate * {d} - {AYANAMSA}')} ELSE {turn(f'{seen} - {AYANAMSA}')} END)"


def bodies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BODIES, "planet string, l0 double, rate double, r double")


def _moved(d: str) -> str:
    now, then = longitude_sql(d), longitude_sql(f"({d} + 1)")
    step = f"({then} - {now} + 540)"
    return f"({step} - 360 * floor({step} / 360) - 180)"


def raw_positions(days: DataFrame) -> DataFrame:
    """(date, planet, longitude, speed) of eight bodies a day."""
    d = f"(datediff(date, DATE'2000-01-01') - 0.5 + {DAILY_HOUR / 24!r})"
    each = days.crossJoin(F.broadcast(bodies(days.sparkSession)))  # eight rows
    return each.select("date", "planet", F.expr(longitude_sql(d)).alias("longitude"), F.expr(_moved(d)).alias("speed"))


def raw_moon(days: DataFrame) -> DataFrame:
    """(date, time_ist, longitude, speed) of the Moon at four times a day."""
    spark = days.sparkSession
    grid = days.crossJoin(F.broadcast(spark.createDataFrame(TIMES, "time_ist string, hour double")))  # four rows
    grid = grid.crossJoin(F.broadcast(bodies(spark).where("planet = 'Moon'")))  # one row
    d = "(datediff(date, DATE'2000-01-01') - 0.5 + hour / 24)"
    return grid.select("date", "time_ist", F.expr(longitude_sql(d)).alias("longitude"), F.lit(13.176396).alias("speed"))

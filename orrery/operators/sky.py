"""Aspects, events and factors from position tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.rounding import rounded

from orrery.functions import astro

# Pairs whose aspects count.
PAIRS = [("Mars", "Saturn"), ("Mars", "Rahu"), ("Mercury", "Rahu"), ("Saturn", "Rahu"), ("Jupiter", "Saturn"), ("Sun", "Saturn"), ("Sun", "Mercury")]
HARD = ["conjunction", "opposition", "square"]
STATIONS = ["Mercury", "Venus", "Mars", "Jupiter", "Saturn"]
HIGH_CHANGE = ["Ardra", "Moola", "Jyeshtha"]
RISKY = ["Ardra", "Moola", "Jyeshtha", "Ashlesha"]
MALEFIC = ["Mars", "Saturn", "Rahu", "Ketu"]


def aspects(positions: DataFrame) -> DataFrame:
    """date, planet_1, planet_2, aspect_type, angle, orb, exact of the pairs that are in a band."""
    pairs = F.broadcast(positions.sparkSession.createDataFrame(PAIRS, "planet_1 string, planet_2 string"))  # seven rows
    side = lambda n: positions.select("date", F.col("planet").alias(f"planet_{n}"), F.col("longitude").alias(f"lon_{n}"))
    both = side(1).join(pairs, "planet_1").join(side(2), ["date", "planet_2"])
    both = both.withColumn("d", astro.distance(F.col("lon_1"), F.col("lon_2"))).withColumn("a", astro.aspect(F.col("d"))).where("a is not null")
    return both.select("date", "planet_1", "planet_2", "a.aspect_type", rounded("d", 2).alias("angle"), "a.orb", astro.exact(F.col("a.orb")).alias("exact"))


def changes(positions: DataFrame) -> DataFrame:
    """Each row beside the same body's row of the date before, if that is the date before of the whole table."""
    days = positions.select("date").distinct()
    days = days.withColumn("before", F.lag("date").over(Window.orderBy("date")))  # one row a day
    w = Window.partitionBy("planet").orderBy("date")
    old = {f"old_{c}": F.lag(c).over(w) for c in ("date", "nakshatra_name", "sign_name", "retrograde")}
    return positions.withColumns(old).join(days, "date").where("old_date = before")


def events(positions: DataFrame) -> DataFrame:
    """event_date, event_type, planet, from_value, to_value, severity: changes of nakshatra, sign and direction."""
    row = lambda kind, a, b, severity: F.struct(F.lit(kind).alias("event_type"), a.alias("from_value"), b.alias("to_value"), severity.alias("severity"))
    way = lambda c: F.when(F.col(c), "retrograde").otherwise("direct")
    made = F.array(
        F.when(F.col("nakshatra_name") != F.col("old_nakshatra_name"), row("nakshatra_change", F.col("old_nakshatra_name"), F.col("nakshatra_name"), F.when(F.col("nakshatra_name").isin(HIGH_CHANGE), "high").otherwise("normal"))),
        F.when(F.col("sign_name") != F.col("old_sign_name"), row("sign_change", F.col("old_sign_name"), F.col("sign_name"), F.lit("normal"))),
        F.when(F.col("planet").isin(STATIONS) & F.col("retrograde") & ~F.col("old_retrograde"), row("retrograde_start", way("old_retrograde"), way("retrograde"), F.lit("high"))),
        F.when(F.col("planet").isin(STATIONS) & ~F.col("retrograde") & F.col("old_retrograde"), row("retrograde_end", way("old_retrograde"), way("retrograde"), F.lit("high"))),
    )
    out = changes(positions).select(F.col("date").alias("event_date"), "planet", F.explode(F.array_compact(made)).alias("e"))
    return out.select("event_date", "e.event_type", "planet", "e.from_value", "e.to_value", "e.severity")


def event_dates(events_: DataFrame, kind: str, planet: str, factor: str) -> DataFrame:
    """(factor, date): dates of one planet's events of one type."""
    return events_.where((F.col("event_type") == kind) & (F.col("planet") == planet)).select(F.lit(factor).alias("factor"), F.col("event_date").alias("date")).distinct()


def speed_transitions(positions: DataFrame, most: int = 1000) -> DataFrame:
    """planet, date, direction, old_speed and speed where a planet's speed changes its sign within its first `most` dates."""
    w = Window.partitionBy("planet").orderBy("date")
    rows = positions.withColumns({"place": F.row_number().over(w), "old_speed": F.lag("speed").over(w)}).where(F.col("place") <= most)
    turn = F.when(F.col("speed") < 0, "DIRECT to RETRO").otherwise("RETRO to DIRECT")
    return rows.where((F.col("old_speed") < 0) != (F.col("speed") < 0)).select("planet", "date", turn.alias("direction"), "old_speed", "speed")

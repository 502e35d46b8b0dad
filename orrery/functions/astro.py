"""Column rules on sidereal longitudes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.rounding import rounded

# Names in order of longitude.
NAKSHATRAS = [
    "Ashwini", "Bharani", "Krittika", "Rohini", "Mrigashira", "Ardra", "Punarvasu", "Pushya", "Ashlesha",
    "Magha", "Purva Phalguni", "Uttara Phalguni", "Hasta", "Chitra", "Swati", "Vishakha", "Anuradha", "Jyeshtha",
    "Moola", "Purva Ashadha", "Uttara Ashadha", "Shravana", "Dhanishta", "Shatabhisha", "Purva Bhadrapada", "Uttara Bhadrapada", "Revati",
]
SIGNS = ["Aries", "Taurus", "Gemini", "Cancer", "Leo", "Virgo", "Libra", "Scorpio", "Sagittarius", "Capricorn", "Aquarius", "Pisces"]
# Largest distance to the Sun, in degrees, at which a body is combust.
COMBUST = {"Moon": 12.0, "Mars": 17.0, "Mercury": 14.0, "Jupiter": 11.0, "Venus": 10.0, "Saturn": 15.0}
# Aspect, angle and largest deviation.
ASPECTS = [("conjunction", 0.0, 10.0), ("opposition", 180.0, 10.0), ("square", 90.0, 8.0), ("trine", 120.0, 8.0)]
SPAN = 360 / 27
# Other spellings of the names above.
ALIASES = {
    "Ashvini": "Ashwini", "Krithika": "Krittika", "Mrigasira": "Mrigashira", "Arudra": "Ardra", "Hastha": "Hasta", "Swathi": "Swati",
    "Jyestha": "Jyeshtha", "Purva Ashada": "Purva Ashadha", "Uttara Ashada": "Uttara Ashadha", "Dhanistha": "Dhanishta",
    "Purva Bhadra": "Purva Bhadrapada", "Uttara Bhadra": "Uttara Bhadrapada", "Revathi": "Revati", "Tauras": "Taurus", "Capricon": "Capricorn",
}


def canonical(name: Column) -> Column:
    pairs = [x for kv in ALIASES.items() for x in map(F.lit, kv)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def _named(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), index + 1)


def sign(lon: Column) -> Column:
    return F.floor(lon / 30).cast("int")


def sign_name(lon: Column) -> Column:
    return _named(SIGNS, sign(lon))


def nakshatra(lon: Column) -> Column:
    return F.floor(lon / SPAN).cast("int")


def nakshatra_name(lon: Column) -> Column:
    return _named(NAKSHATRAS, nakshatra(lon))


def pada(lon: Column) -> Column:
    return (F.floor((lon - F.floor(lon / SPAN) * SPAN) / (SPAN / 4)) + 1).cast("int")


def gandanta(lon: Column) -> Column:
    """Close to where a water sign ends and a fire sign begins."""
    inside, s = lon - F.floor(lon / 30) * 30, sign(lon)
    return (s.isin(3, 7, 11) & (inside > 26.67)) | (s.isin(0, 4, 8) & (inside < 3.33))


def distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360 - d)


def combust(planet: Column, lon: Column, sun: Column) -> Column:
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in COMBUST.items() for x in kv]), planet)
    return F.coalesce(distance(lon, sun) <= limit, F.lit(False))


def aspect(diff: Column) -> Column:
    """struct(type, orb) of the band that an angular distance is in, null between the bands."""
    out = F.lit(None).cast("struct<aspect_type:string,orb:double>")
    for name, angle, orb in reversed(ASPECTS):
        off = F.abs(diff - angle)
        out = F.when(off <= orb, F.struct(F.lit(name).alias("aspect_type"), rounded(off, 2).alias("orb"))).otherwise(out)
    return out


# Elements of the signs, in order, again and again; kinds of bodies.
ELEMENTS = ["Fire", "Earth", "Air", "Water"]
CLASSICAL = ["Sun", "Moon", "Mars", "Mercury", "Jupiter", "Venus", "Saturn"]
NODES = ["Rahu", "Ketu"]


def category(planet: Column) -> Column:
    """D30."""
    return F.when(planet.isin(CLASSICAL), "classical").when(planet.isin(NODES), "node").otherwise("outer")


def spans(spark: SparkSession) -> DataFrame:
    """Kind, id, name, element, start_deg and end_deg of the 27 nakshatras (four digits) and 12 signs (one digit)."""
    nak = spark.createDataFrame(list(enumerate(NAKSHATRAS)), "i long, name string")
    nak = nak.select(F.lit("nakshatra").alias("kind"), (F.col("i") + 1).alias("id"), "name", F.lit(None).cast("string").alias("element"), *[rounded((F.col("i") + k) * SPAN, 4).alias(c) for k, c in ((0, "start_deg"), (1, "end_deg"))])
    signs = spark.createDataFrame([(i, n, ELEMENTS[i % 4]) for i, n in enumerate(SIGNS)], "i long, name string, element string")
    return nak.unionByName(signs.select(F.lit("sign").alias("kind"), (F.col("i") + 1).alias("id"), "name", "element", *[rounded((F.col("i") + k) * 30.0, 1).alias(c) for k, c in ((0, "start_deg"), (1, "end_deg"))]))


def exact(orb: Column) -> Column:
    return orb <= 1.0

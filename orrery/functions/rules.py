"""Scoring and labelling rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.rounding import rounded

REGIMES = ["Accumulation", "Expansion", "Distribution", "Capital Protection"]
CAP = 25.0


def aspect_score(orb: Column, most: float, exact: Column) -> Column:
    """0 without an aspect, all points if exact, else falling to 0 at 10 degrees."""
    fading = rounded(F.greatest(F.lit(0.0), most * (1 - F.abs(orb) / 10)), 1)
    return F.when(orb.isNull(), F.lit(0.0)).when(exact, F.lit(float(most))).otherwise(fading)


def capped(score: Column) -> Column:
    return F.least(score, F.lit(CAP))


def regime(score: Column) -> Column:
    return F.when(score <= 30, REGIMES[0]).when(score <= 50, REGIMES[1]).when(score <= 70, REGIMES[2]).otherwise(REGIMES[3])


def display_regime(score: Column) -> Column:
    return F.when(score >= 71, REGIMES[3]).when(score >= 51, REGIMES[2]).when(score >= 31, REGIMES[1]).otherwise(REGIMES[0])


def band(score: Column) -> Column:
    return F.when(score > 70, "red").when(score > 40, "amber").otherwise("green")


def volatility_label(score: Column) -> Column:
    return F.when(score > 60, "High").when(score > 35, "Med").otherwise("Low")


def was_right(score: Column, ret: Column) -> Column:
    return ((score > 50) & (ret < 0)) | ((score <= 50) & (ret >= 0))


def signal(down: Column, baseline: Column) -> Column:
    d = down - baseline
    return F.when(d > 3, "BEARISH").when(d < -3, "BULLISH").otherwise("NEUTRAL")


def half_up(x: Column, digits: int = 2) -> Column:
    """Halves towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def explanation(score: Column, regime_: Column, factors: Column, broken: Column, most: int = 3) -> Column:
    """factors: array of struct(name, points, place, whole), points above 0. The largest by points, then by place. Numbers that are not whole by rule have one digit; `broken` says so of the score."""
    number = lambda x, whole: F.when(whole, x.cast("int").cast("string")).otherwise(x.cast("decimal(10,1)").cast("string"))
    ranked = F.slice(F.sort_array(F.transform(factors, lambda f: F.struct((-f["points"]).alias("k"), f["place"], f["name"], f["points"], f["whole"]))), 1, most)
    shown = F.array_join(F.transform(ranked, lambda f: F.concat(f["name"], F.lit(" (+"), number(f["points"], f["whole"]), F.lit(")"))), ", ")
    start = F.concat(F.lit("Risk "), number(score, ~broken), F.lit("/100 ("), regime_, F.lit("). "))
    return F.concat(start, F.when(F.size(factors) > 0, F.concat(F.lit("Key factors: "), shown)).otherwise(F.lit("No significant risk factors active.")))


def string_hash(text: Column) -> Column:
    """31-multiplier hash of the code points, wrapped to 32 bits, without sign."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: wrap(h * 31 + c)))


def demo_factors(date_: Column, symbol: Column) -> Column:
    """Struct of four demonstration factors that share out the seeded score of (date, symbol), halves rounded up."""
    joined = lambda tail: string_hash(F.concat_ws("-", date_.cast("string"), symbol, F.lit(tail)))
    total, s = demo_score(joined("")), joined("f")
    raw = [F.pmod(F.shiftright(s, n), F.lit(25)) for n in (0, 4, 8, 12)]
    whole = raw[0] + raw[1] + raw[2] + raw[3]
    share = lambda x: F.floor(x / F.when(whole == 0, 1).otherwise(whole) * total + 0.5).cast("bigint")
    return F.struct(*[share(x).alias(n) for x, n in zip(raw, ("structural", "momentum", "volatility", "deception"), strict=True)])


def demo_score(seed: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(5), F.pmod(seed, F.lit(70)) + 5 + F.when(F.pmod(seed, F.lit(17)) > 12, 20).otherwise(0))).cast("bigint")

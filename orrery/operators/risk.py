"""Daily risk scores and factor statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.rounding import rounded

from orrery.functions import rules
from orrery.operators import sky


def day_factors(dates: DataFrame, positions: DataFrame, pair_aspects: DataFrame, moon: DataFrame) -> DataFrame:
    """One row a date: retrograde flags, orbs of the hard pair aspects, the Moon's nakshatra and gandanta at 09:15, malefic aspects."""
    retro = positions.groupBy("date").agg(
        *[F.bool_or((F.col("planet") == p) & F.col("retrograde")).alias(f"{p.lower()}_r") for p in sky.STATIONS],
        F.max(F.when(F.col("planet") == "Moon", F.col("nakshatra_name"))).alias("daily_nakshatra"),
    )
    pair = lambda a, b: (F.least("planet_1", "planet_2") == min(a, b)) & (F.greatest("planet_1", "planet_2") == max(a, b))
    hard = pair_aspects.where(F.col("aspect_type").isin(sky.HARD))
    used = [("saturn", "rahu"), ("jupiter", "saturn"), ("mars", "saturn"), ("mars", "rahu"), ("mercury", "rahu")]
    near = hard.groupBy("date").agg(
        *[F.min(F.when(pair(a.title(), b.title()), F.struct("orb", "exact", "aspect_type"))).alias(f"{a}_{b}") for a, b in used],
        F.sum((F.col("planet_1").isin(sky.MALEFIC) & F.col("planet_2").isin(sky.MALEFIC)).cast("int")).cast("bigint").alias("malefic"),
    )
    at = moon.where("time_ist = '09:15'").select("date", F.col("nakshatra_name").alias("moon_nakshatra"), "gandanta")
    out = dates.select("date").join(retro, "date", "left").join(near, "date", "left").join(at, "date", "left")
    return out.withColumns({
        "moon_nakshatra": F.coalesce(F.nullif("moon_nakshatra", F.lit("")), "daily_nakshatra"),
        "gandanta": F.coalesce("gandanta", F.lit(False)),
        "malefic": F.coalesce("malefic", F.lit(0)),
    }).drop("daily_nakshatra")


def factor_points() -> list[tuple[str, Column, Column, Column]]:
    """(dimension, name, points, whole) of every factor, in the order that breaks ties; whole: the points are a whole number by rule."""
    yes, no = F.lit(True), F.lit(False)
    flag = lambda d, n, c, p: (d, F.lit(n), F.when(F.coalesce(F.col(c), no), float(p)).otherwise(0.0), yes)

    def pair(d: str, a: str, b: str, most: int) -> tuple[str, Column, Column, Column]:
        c = F.col(f"{a}_{b}".lower())
        return d, F.concat(F.lit(f"{a}-{b} "), c["aspect_type"]), rules.aspect_score(c["orb"], most, c["exact"]), F.coalesce(c["exact"], no)

    malefic = F.col("malefic").cast("string")
    return [
        flag("structural", "Saturn Retrograde", "saturn_r", 8),
        flag("structural", "Jupiter Retrograde", "jupiter_r", 5),
        pair("structural", "Saturn", "Rahu", 7),
        pair("structural", "Jupiter", "Saturn", 5),
        flag("momentum", "Mars Retrograde", "mars_r", 10),
        pair("momentum", "Mars", "Saturn", 10),
        pair("momentum", "Mars", "Rahu", 8),
        ("volatility", F.concat(F.lit("Moon in "), "moon_nakshatra"), F.when(F.col("moon_nakshatra").isin(sky.RISKY), 10.0).otherwise(0.0), yes),
        flag("volatility", "Moon Gandanta", "gandanta", 8),
        ("volatility", F.concat(malefic, F.when(F.col("malefic") >= 3, " malefic aspects clustering").otherwise(" malefic aspects")), F.when(F.col("malefic") >= 3, 7.0).when(F.col("malefic") == 2, 4.0).otherwise(0.0), yes),
        flag("deception", "Mercury Retrograde", "mercury_r", 12),
        pair("deception", "Mercury", "Rahu", 10),
        flag("deception", "Venus Retrograde", "venus_r", 3),
    ]


DIMENSIONS = ("structural", "momentum", "volatility", "deception")


def risk_scores(factors: DataFrame, symbol: str | None = None) -> DataFrame:
    """date, composite_score, its four dimensions, regime and explanation; the symbol only tags the rows."""
    points = factor_points()
    df = factors.withColumns({f"__p{i}": p for i, (_, _, p, _) in enumerate(points)})
    total = lambda d: sum((F.col(f"__p{i}") for i, (x, *_) in enumerate(points) if x == d), F.lit(0.0))
    df = df.withColumns({d: rules.capped(total(d)) for d in DIMENSIONS})
    df = df.withColumn("composite_score", rounded(sum((F.col(d) for d in DIMENSIONS), F.lit(0.0)), 1))
    parts = F.array(*[F.struct(n.alias("name"), F.col(f"__p{i}").alias("points"), F.lit(i).alias("place"), whole.alias("whole")) for i, (_, n, _, whole) in enumerate(points)])
    # a total is written with a digit if a fading aspect is in it; a dimension at its cap is a whole number
    in_part = lambda d: sum(((~whole & (F.col(f"__p{i}") > 0)).cast("int") for i, (x, _, _, whole) in enumerate(points) if x == d), F.lit(0)) > 0
    broken = [in_part(d) & (total(d) <= rules.CAP) for d in DIMENSIONS]
    df = df.withColumn("regime", rules.regime(F.col("composite_score")))
    df = df.withColumn("explanation", rules.explanation(F.col("composite_score"), F.col("regime"), F.filter(parts, lambda f: f["points"] > 0), broken[0] | broken[1] | broken[2] | broken[3]))
    return df.select("date", *([F.lit(symbol).alias("symbol")] if symbol else []), "composite_score", *DIMENSIONS, "regime", "explanation")


def _stats(ret: str = "daily_return", reach: str = "daily_range_pct") -> list[Column]:
    down = F.avg(F.when(F.col(ret) < 0, 100.0).otherwise(0.0))
    return [F.count("*").alias("n"), down.alias("down"), F.avg(ret).alias("mean"), F.coalesce(F.avg(reach), F.lit(0.0)).alias("reach")]


def baseline(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """n, down, mean and reach of the rows with a return, for each symbol."""
    return bars.where("daily_return is not null").groupBy(key).agg(*_stats())


def factor_stats(bars: DataFrame, factors: DataFrame, least: int = 5) -> DataFrame:
    """Statistics of each factor's days against all days of the symbol, in one join for all factors; fewer than `least` days are left out."""
    base = baseline(bars).select("symbol", F.col("down").alias("base_down"), F.col("mean").alias("base_mean"), F.col("reach").alias("base_reach"))
    out = bars.where("daily_return is not null").join(factors, "date").groupBy("symbol", "factor").agg(*_stats()).where(F.col("n") >= least).join(base, "symbol")
    return out.select(
        F.col("factor").alias("factor_type"), F.col("symbol").alias("index_symbol"),
        rounded("down", 2).alias("pct_down_days"), rounded("mean", 4).alias("avg_return"), rounded("reach", 4).alias("avg_range_pct"),
        rounded(F.when(F.col("base_reach") > 0, F.col("reach") / F.col("base_reach")).otherwise(1.0), 2).alias("volatility_multiplier"),
        F.col("n").alias("sample_count"), rounded("base_down", 2).alias("baseline_down_pct"), rounded("base_mean", 4).alias("baseline_avg_return"),
    )


def report(stats: DataFrame) -> DataFrame:
    return stats.select("factor_type", "index_symbol", "pct_down_days", "sample_count", rules.signal(F.col("pct_down_days"), F.col("baseline_down_pct")).alias("signal"))


def regime_distribution(scores: DataFrame) -> DataFrame:
    spark = scores.sparkSession
    order = spark.createDataFrame([(i, r) for i, r in enumerate(rules.REGIMES)], "place long, regime string")
    found = scores.groupBy("regime").agg(F.count("*").alias("n"))
    total = scores.agg(F.count("*").alias("total"))
    out = order.join(found, "regime", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("place", "regime", F.coalesce("n", F.lit(0)).alias("n"), rounded(F.coalesce("n", F.lit(0)) * 100.0 / F.greatest("total", F.lit(1)), 2).alias("pct"))


def histogram(scores: DataFrame) -> DataFrame:
    """Ten whole-number buckets; scores between two of them are in none."""
    spark = scores.sparkSession
    buckets = spark.createDataFrame([(0 if i == 0 else 10 * i + 1, 10 * i + 10) for i in range(10)], "lo long, hi long")
    hit = scores.join(F.broadcast(buckets), F.col("composite_score").between(F.col("lo"), F.col("hi"))).groupBy("lo", "hi").agg(F.count("*").alias("n"))
    return buckets.join(hit, ["lo", "hi"], "left").fillna(0, ["n"])


def cohorts(scores: DataFrame, bars: DataFrame, thresholds: tuple[int, ...] = (50, 60, 70)) -> DataFrame:
    """Returns on days whose score reaches each threshold, 0 standing for all days."""
    spark = scores.sparkSession
    limits = F.broadcast(spark.createDataFrame([(t,) for t in (0, *thresholds)], "threshold int"))  # a few rows
    both = bars.where("daily_return is not null").join(scores.select("date", "composite_score"), "date")
    return both.join(limits, F.col("composite_score") >= F.col("threshold")).groupBy("symbol", "threshold").agg(
        F.count("*").alias("n"), rounded(F.avg(F.when(F.col("daily_return") < 0, 100.0).otherwise(0.0)), 2).alias("down_pct"), rounded(F.avg("daily_return"), 4).alias("avg_return")
    )

"""Composite indicators over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import blocks
from orrery.operators import series as s
from orrery.operators.asof import asof_join

#: Tasks that share a block of time of the one benchmark.
SHARED = 8


def momentum_spread(bars: DataFrame, fast: int = 10, slow: int = 40, period: int = 5, look_back: int = 40, divergence: int = 14) -> DataFrame:
    """RSI of the spread of two averages, smoothed; four kinds of new high over `look_back` rows; divergence of price and RSI(14) over `divergence` rows."""
    w = blocks.window()
    df = blocks.haloed(blocks.numbered(bars), slow)
    df = blocks.own(df.withColumn("spread", s.sma("close", w, fast) - s.sma("close", w, slow)))
    df = s.smoothed(df, {"rs": ("spread", period), "rsi": ("close", 14)})
    df = blocks.haloed(df, max(look_back + 3, divergence)).withColumn("smooth", s.sma("rs", w, 3))
    below = F.col("close") < s.highest("close", w, look_back)
    df = df.withColumn("range_high", F.col("smooth") > s.highest("smooth", w, look_back, 1))
    df = df.withColumns({
        "range_high_before_price": F.col("range_high") & below,
        "__below": below,
        "bearish": (s.highest("high", w, divergence) == F.col("high")) & (F.col("rsi") < s.highest("rsi", w, divergence)),
        "bullish": (s.lowest("low", w, divergence) == F.col("low")) & (F.col("rsi") > s.lowest("rsi", w, divergence)),
    })
    df = blocks.record_before(blocks.own(df), "smooth", "__record").withColumn("new_high", F.col("smooth") > F.col("__record"))
    return df.withColumn("new_high_before_price", F.col("new_high") & F.col("__below")).drop("__below", "__record")


def relative_strength(bars: DataFrame, bench: DataFrame, long: int = 144, ma: int = 60, atr: int = 14, order: str = "date", atr_ma: int = 100) -> DataFrame:
    """Close over the benchmark's last value known at each bar (J13), its distance from its average, and the zone by a threshold that follows volatility."""
    w = blocks.window()
    df = asof_join(bars, bench, order, ["bench"], salts=SHARED)
    df = blocks.haloed(blocks.numbered(df, order=order), long + ma)
    df = df.withColumn("rs", F.try_divide("close", "bench"))
    df = df.withColumn("strength", (F.try_divide(F.col("rs"), s.sma("rs", w, long)) - 1) * 100)
    df = df.withColumn("average", s.sma("strength", w, ma)).withColumn("diff", F.abs(F.col("strength") - F.col("average")))
    df = blocks.haloed(s.with_atr(blocks.own(df), atr, order=order), atr_ma)
    df = blocks.own(df.withColumn("threshold", 6 * F.try_divide(F.col("atr"), s.sma("atr", w, atr_ma))))
    t, d = F.col("threshold"), F.col("diff")
    up = F.when(d > t * 1.5, "Strong Bull").when(d > t, "Mild Bull").otherwise("Neutral")
    down = F.when(d > t * 1.5, "Strong Bear").when(d > t, "Mild Bear").otherwise("Neutral")
    df = df.withColumn("zone", F.when(F.col("strength") > F.col("average"), up).otherwise(down))
    return df.withColumn("zone_value", zone_value(F.col("zone")))


ZONES = ["Strong Bull", "Mild Bull", "Strong Bear", "Mild Bear", "Neutral"]


def zone_value(zone: Column) -> Column:
    return F.when(zone == "Strong Bull", 2).when(zone == "Mild Bull", 1).when(zone == "Strong Bear", -2).when(zone == "Mild Bear", -1).otherwise(0).cast("bigint")


def screens(bars: DataFrame, weeks: int = 8) -> DataFrame:
    """A large move, a mild correction, and volume near an average; score and status."""
    w, n = blocks.window(), weeks * 5
    then, high = F.lag("close", n).over(w), s.highest("high", w, n)
    close = F.col("close")
    near = lambda k: F.coalesce(F.abs((close - s.sma("close", w, k)) / s.sma("close", w, k)) * 100 <= 3.0, F.lit(False))
    df = blocks.haloed(blocks.numbered(bars), max(n, 200)).withColumns({
        "moved": F.when(then > 0, (close - then) / then * 100).otherwise(0.0),
        "corrected": F.when(high > 0, (high - close) / high * 100).otherwise(0.0),
        "busy": F.coalesce(F.col("volume") >= s.sma("volume", w, 20) * 1.5, F.lit(False)),
        "near": near(21) | near(50) | near(200),
    })
    df = df.withColumns({"emd": F.col("moved") >= 100, "ca": F.col("corrected").between(0, 20), "vmac": F.col("busy") & F.col("near")})
    df = df.withColumn("score", sum((F.col(c).cast("bigint") for c in ("emd", "ca", "vmac")), F.lit(0).cast("bigint")))
    df = blocks.own(df)
    return df.withColumn("status", F.when(F.col("score") == 3, "Perfect").when(F.col("score") == 2, "Strong").when(F.col("score") == 1, "Partial").otherwise("Weak"))


def signals(df: DataFrame) -> DataFrame:
    """K19 to K23 on columns of relative_strength and screens: agreement, label, five-bar momentum with its strength, alerts, a flag for each zone."""
    df, w = blocks.haloed(blocks.numbered(df), 5), blocks.window()
    bull = F.coalesce(F.col("strength") > F.col("average"), F.lit(False))
    df = df.withColumn("bull", bull)
    score = F.when(bull & F.col("emd"), 2).otherwise(0) + F.when(bull & F.col("ca"), 1).otherwise(0) + F.when(F.col("vmac"), 1).otherwise(0)
    df = df.withColumn("agreement", score.cast("bigint"))
    back = F.lag("strength", 5).over(w)
    moved = F.abs(F.col("strength") - back)
    flags = {f"is_{z.lower().replace(' ', '_')}": (F.col("zone") == z).cast("int") for z in ZONES}  # K23
    far = F.coalesce(F.col("diff") > F.col("threshold"), F.lit(False))
    return blocks.own(df.withColumns({
        "agreement_status": F.when(score >= 4, "Excellent").when(score >= 3, "Strong").when(score >= 2, "Moderate").otherwise("Weak"),
        "signal": F.when(bull & (F.col("score") >= 3) & far, "Perfect Entry").when(bull & (F.col("score") >= 2) & (F.col("diff") > F.col("threshold") * 0.5), "Strong Entry").when(~bull & (F.col("score") <= 1), "Caution/Exit").otherwise("Wait"),
        "direction": F.when(F.col("strength") > back, "Up").when(F.col("strength") < back, "Down").otherwise("Flat"),
        "momentum": moved,
        "momentum_label": F.when(moved > 2, "Strong").when(moved > 1, "Moderate").otherwise("Weak"),
        **flags,
        "crossed": crossed(F.col("strength"), F.col("average"), w),
        "moved_far": F.coalesce(far & (F.lag("diff").over(w) <= F.col("threshold")), F.lit(False)),
        "zone_changed": F.coalesce(F.col("zone") != F.lag("zone").over(w), F.lit(False)),
        "perfect": F.coalesce((F.col("score") >= 3) & (F.lag("score").over(w) < 3), F.lit(False)),
        "ultimate": bull & (F.col("score") >= 3) & far,
    }))


def crossed(a: Column, b: Column, w) -> Column:
    """A is above b and was not in the row before, or below and was not; so a touch counts when it is left."""
    was_a, was_b = F.lag(a).over(w), F.lag(b).over(w)
    return F.coalesce(((a > b) & (was_a <= was_b)) | ((a < b) & (was_a >= was_b)), F.lit(False))


def oscillators(bars: DataFrame) -> DataFrame:
    """Two clamped RSI lines and half of an RSI."""
    df = s.smoothed(bars, {"rsi9": ("close", 9), "rsi4": ("close", 4)})
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(50.0))
    return df.withColumns({"banker": clamp(1.5 * (F.col("rsi9") - 61)), "hot_money": clamp(1.0 * (F.col("rsi4") - 15)), "line": F.col("rsi9") / 2})


def interval_extremes(df: DataFrame, order: str = "time", sizes: tuple[int, ...] = (60, 120, 240)) -> DataFrame:
    """At bars that begin a new interval of so many minutes, whether relative strength is the highest or lowest of as many rows; elsewhere false."""
    df, w = blocks.haloed(blocks.numbered(df, order=order), max(sizes)), blocks.window()
    flags = {}
    for n in sizes:
        interval = F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / (60 * n))
        turns = interval != F.lag(interval).over(w)
        flags[f"high_{n}"] = F.coalesce(turns & (F.col("strength") == s.highest("strength", w, n)), F.lit(False))
        flags[f"low_{n}"] = F.coalesce(turns & (F.col("strength") == s.lowest("strength", w, n)), F.lit(False))
    return blocks.own(df.withColumns(flags))

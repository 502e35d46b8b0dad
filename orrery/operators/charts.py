"""Chart rows and statistics of one series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import rules
from orrery.operators import series

RANGES = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12, "5Y": 60, "MAX": None}


def in_range(bars: DataFrame, span: str, as_of: date) -> DataFrame:
    months = RANGES[span]
    return bars if months is None else bars.where(F.col("date") >= F.add_months(F.lit(as_of), -months))


def chart_rows(bars: DataFrame, span: str, as_of: date, most: int = 10_000) -> DataFrame:
    """Rows of the range, the oldest `most` of each symbol, missing prices shown as 0."""
    w = Window.partitionBy("symbol").orderBy("date")
    df = in_range(bars, span, as_of).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("open", "high", "low", "close")})


def statistics(bars: DataFrame, span: str, as_of: date, within_range: bool = False) -> DataFrame:
    """Last close, change against the close before, and the highest and lowest of the last 252 rows, of the range only if asked for."""
    ranged = in_range(bars, span, as_of)
    w = Window.partitionBy("symbol").orderBy("date")
    last = series.last_rows(ranged.withColumn("prev", F.coalesce(F.lag("close").over(w), F.col("close"), F.lit(0.0))), 1)
    year = series.last_rows(ranged if within_range else bars.where(F.col("date") <= F.lit(as_of)), 252)
    year = year.groupBy("symbol").agg(F.coalesce(F.max(F.nullif("high", F.lit(0.0))), F.lit(0.0)).alias("high_52w"), F.coalesce(F.min("low"), F.lit(0.0)).alias("low_52w"))
    change = F.col("close") - F.col("prev")
    return last.join(year, "symbol", "left").select(
        "symbol", "date", "close", "prev",
        rules.half_up(change).alias("change"), rules.half_up(F.when(F.col("prev") > 0, change / F.col("prev") * 100).otherwise(0.0)).alias("change_pct"), "high_52w", "low_52w",
    )


def axis(bars: DataFrame) -> DataFrame:
    """Lowest and highest shown value with 5 % of the spread around, 100 if there is none."""
    df = bars.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * 0.05).otherwise(100.0)
    return df.select("symbol", F.floor(F.col("lo") - pad).alias("axis_low"), F.ceil(F.col("hi") + pad).alias("axis_high"))

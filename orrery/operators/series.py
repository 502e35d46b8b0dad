"""Ordered-series operators over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.rounding import rounded
from orrery.operators import blocks


def by(*keys: str, order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def with_returns(bars: DataFrame, key: str = "symbol", drop_first: bool = False) -> DataFrame:
    """daily_return, gap_pct and daily_range_pct, in percent to four digits; null where a base is missing or not positive."""
    prev = F.lag("close").over(by(key))
    pct = lambda a, b: rounded((a - b) / b * 100, 4)
    out = bars.withColumn("prev", prev).withColumns({
        "daily_return": F.when(F.col("prev") > 0, pct(F.col("close"), F.col("prev"))),
        "gap_pct": F.when((F.col("open") > 0) & (F.col("prev") > 0), pct(F.col("open"), F.col("prev"))),
        "daily_range_pct": F.when(F.col("open") > 0, rounded((F.col("high") - F.col("low")) / F.col("open") * 100, 4)),
    })
    return (out.where("prev is not null") if drop_first else out).drop("prev")


def _rows(w, a: int, b: int):
    return w.rowsBetween(a, b)


def full(value, w, n: int, shift: int = 0) -> Column:
    """value over the n rows up to `shift` rows ago, null until there are n."""
    frame = _rows(w, -(n - 1) - shift, -shift)
    return F.when(F.count(F.lit(1)).over(frame) == n, value.over(frame))


def sma(c: str, w, n: int) -> Column:
    frame = _rows(w, -(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))


def highest(c: str, w, n: int, shift: int = 0) -> Column:
    return full(F.max(c), w, n, shift)


def lowest(c: str, w, n: int, shift: int = 0) -> Column:
    return full(F.min(c), w, n, shift)


def rsi_of(up: Column, down: Column) -> Column:
    return F.when(down == 0, 100.0).when(up == 0, 0.0).otherwise(100 - 100 / (1 + F.try_divide(up, down)))


def smoothed(df: DataFrame, rsi: dict[str, tuple[str, int]] | None = None, atr: dict[str, int] | None = None, key: str = "symbol", order: str = "date") -> DataFrame:
    """RSIs (name to source and n) and ATRs (name to n) of each key's rows, all from one pass of blocks.recursive(); rows keep their places (__i, __p)."""
    sources, rsi = {}, rsi or {}
    df, w = blocks.haloed(blocks.numbered(df, key, order), 1), blocks.window(key)
    for i, (source, n) in enumerate(rsi.values()):
        step = F.col(source) - F.lag(source).over(w)
        df = df.withColumns({f"__up{i}": F.greatest(step, F.lit(0.0)) + step * 0, f"__down{i}": F.greatest(-step, F.lit(0.0)) + step * 0})
        sources |= {f"__u{i}": (f"__up{i}", n), f"__d{i}": (f"__down{i}", n)}
    if atr:
        prev = F.lag("close").over(w)
        df = df.withColumn("__tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
        sources |= {name: ("__tr", n) for name, n in atr.items()}
    out = blocks.recursive(blocks.own(df), sources, key)
    out = out.withColumns({name: rsi_of(F.col(f"__u{i}"), F.col(f"__d{i}")) for i, name in enumerate(rsi)}) if rsi else out
    return out.drop("__tr", *[f"__{c}{i}" for i in range(len(rsi)) for c in ("up", "down", "u", "d")])


def with_rsi(df: DataFrame, source: str, n: int, name: str, key: str = "symbol", order: str = "date") -> DataFrame:
    return smoothed(df, {name: (source, n)}, None, key, order)


def with_atr(df: DataFrame, n: int, name: str = "atr", key: str = "symbol", order: str = "date") -> DataFrame:
    return smoothed(df, None, {name: n}, key, order)


def last_rows(df: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))).where(F.col("__r") <= n).drop("__r")


def down_sampled(df: DataFrame, most: int = 500, key: str = "symbol") -> DataFrame:
    """Every ceil(n / most)-th row from the first, and the last."""
    n, i = F.count("*").over(Window.partitionBy(key)), F.row_number().over(by(key)) - 1
    df = df.withColumns({"__n": n, "__i": i})
    return df.where((F.col("__n") <= most) | (F.col("__i") % F.ceil(F.col("__n") / most) == 0) | (F.col("__i") == F.col("__n") - 1)).drop("__n", "__i")

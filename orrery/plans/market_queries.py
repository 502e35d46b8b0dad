"""Queries on bars: returns, windows, charts, indicators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.rounding import rounded

from orrery.operators import blocks, charts, indicators, risk, series
from orrery.plans import sql
from orrery.sources import market

AS_OF = date(2001, 6, 30)


def bars(spark: SparkSession, d: str) -> DataFrame:
    return series.with_returns(market.trade_bars(market.table(spark, d, "lineitem")))


def plain(spark: SparkSession, d: str) -> DataFrame:
    return market.trade_bars(market.table(spark, d, "lineitem"))


def bench(spark: SparkSession, d: str) -> DataFrame:
    o = market.table(spark, d, "orders")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(rounded(F.avg("o_totalprice"), 4).alias("bench"))


def s_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Without each symbol's first row, prices to two digits."""
    out = series.with_returns(plain(spark, d), drop_first=True)
    return out.withColumns({c: rounded(c, 2) for c in ("open", "high", "low", "close")})


def event_days(spark: SparkSession, d: str) -> DataFrame:
    return market.event_bars(market.table(spark, d, "events"))


def baseline(spark: SparkSession, d: str) -> DataFrame:
    return risk.baseline(bars(spark, d)).select("symbol", "n", rounded("down", 4).alias("down"), rounded("mean", 5).alias("mean"), rounded("reach", 5).alias("reach"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    return plain(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.min("close").alias("least"), F.max("close").alias("most"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    return plain(spark, d).agg(F.countDistinct("symbol").alias("symbols"), F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def busiest(spark: SparkSession, d: str) -> DataFrame:
    """Ten years and symbols with most bars."""
    return plain(spark, d).groupBy("symbol", F.year("date").alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol", "year").limit(10)


def windows(spark: SparkSession, d: str) -> DataFrame:
    df, w = blocks.haloed(blocks.numbered(plain(spark, d)), 40), blocks.window()
    df = df.withColumns({
        "sma20": rounded(series.sma("close", w, 20), 5), "high20": series.highest("high", w, 20), "low20": series.lowest("low", w, 20),
        "high20_before": series.highest("high", w, 20, 1), "close5": F.lag("close", 5).over(w), "close40": F.lag("close", 40).over(w),
    })
    df = blocks.record_before(blocks.own(df), "close", "record")
    return df.select("symbol", "date", "sma20", "high20", "low20", "high20_before", "close5", "close40", (F.col("close") > F.col("record")).alias("new_high"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Crossings of close and its average, and how long a side lasts."""
    w = blocks.window()
    df = blocks.haloed(blocks.numbered(plain(spark, d)), 20).withColumn("average", series.sma("close", w, 20))
    df = df.withColumn("crossed", indicators.crossed(F.col("close"), F.col("average"), w))
    df = blocks.plain(blocks.own(df).where("average is not null")).withColumn("above", F.col("close") > F.col("average"))
    df = blocks.run_lengths(blocks.numbered(df), "above", "duration")
    return df.select("symbol", "date", "above", "crossed", "duration", (F.col("duration") - 1).alias("stability"))


def smoothed(spark: SparkSession, d: str) -> DataFrame:
    """RSI(9) and ATR(14)."""
    df = series.smoothed(plain(spark, d), {"rsi": ("close", 9)}, {"atr": 14})
    return df.select("symbol", "date", rounded("rsi", 4).alias("rsi"), rounded("atr", 4).alias("atr"))


def rounded_table(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def screens(spark: SparkSession, d: str) -> DataFrame:
    return rounded_table(indicators.screens(plain(spark, d)).select("symbol", "date", "moved", "corrected", "emd", "ca", "vmac", "score", "status"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    df = indicators.signals(indicators.screens(indicators.relative_strength(plain(spark, d), bench(spark, d))))
    return df.select("symbol", "date", *[rounded(c, 4).alias(c) for c in ("strength", "average", "threshold", "momentum")], "zone", "zone_value", "agreement", "agreement_status", "signal", "direction", "momentum_label", *[c for c in df.columns if c.startswith("is_")], "crossed", "moved_far", "zone_changed", "perfect", "ultimate")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """Each bar beside the benchmark's last known value."""
    df = indicators.relative_strength(plain(spark, d), bench(spark, d))
    return df.select("symbol", "date", "bench", rounded("strength", 4).alias("strength"))


def intraday(spark: SparkSession, d: str) -> DataFrame:
    """Bars of half an hour of each type of event."""
    return market.intraday_bars(market.table(spark, d, "events"), 30)


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """New extremes of strength against one type, at the borders of 60, 120 and 240 minutes."""
    df = intraday(spark, d)
    df = indicators.relative_strength(df, df.where("symbol = 'view'").select("time", F.col("close").alias("bench")), order="time")
    df = indicators.interval_extremes(df)
    return df.select("symbol", "time", "bench", rounded("strength", 4).alias("strength"), *[f"{k}_{n}" for n in (60, 120, 240) for k in ("high", "low")])


QUERIES = {
    "d01_market_daily": bars, "d04_trimmed_daily": s_trimmed, "s14_calendar": lambda s, d: market.calendar(plain(s, d)), "s15_event_bars": event_days,
    "a01_baseline": baseline, "a04_symbol_summary": summary, "a05_totals": totals, "o02_busiest_years": busiest,
    "n11_windows": windows, "n22_runs": runs, "n16_smoothed": smoothed, "k18_screens": screens, "j13_aligned_strength": aligned,
    "k16_momentum_spread": lambda s, d: rounded_table(indicators.momentum_spread(plain(s, d)).select("symbol", "date", "spread", "rs", "smooth"), 3),
    "k16_new_highs": lambda s, d: indicators.momentum_spread(plain(s, d)).select("symbol", "date", "new_high", "range_high", "new_high_before_price", "range_high_before_price", "bearish", "bullish"), "k19_signals": signals,
    "k24_oscillators": lambda s, d: rounded_table(indicators.oscillators(plain(s, d)).select("symbol", "date", F.when(F.col("rsi9").isNotNull(), F.col("banker")).alias("banker"), F.when(F.col("rsi4").isNotNull(), F.col("hot_money")).alias("hot_money"), "line")),
    "k25_interval_extremes": intervals, "n24_intraday_bars": intraday,
    "k15_chart_rows": lambda s, d: charts.chart_rows(bars(s, d), "1Y", AS_OF), "k15_statistics": lambda s, d: charts.statistics(plain(s, d), "1Y", AS_OF),
    "k15_statistics_ranged": lambda s, d: charts.statistics(plain(s, d), "1M", AS_OF, within_range=True),
    "d27_axis": lambda s, d: charts.axis(plain(s, d)), "n09_down_sampled": lambda s, d: series.down_sampled(plain(s, d)), "n08_last_rows": lambda s, d: series.last_rows(plain(s, d), 252),
}

_w = "PARTITION BY symbol ORDER BY date"
_full = lambda e, n, shift=0: f"CASE WHEN count(*) OVER ({_w} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'}) = {n} THEN {e} OVER ({_w} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'}) END"
_bench = "bench AS (SELECT CAST(o_orderdate AS DATE) AS date, round_even(avg(o_totalprice), 4) AS bench FROM orders GROUP BY 1)"
_t = "PARTITION BY symbol ORDER BY time"
_intraday = """intra AS (SELECT event_type AS symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS time, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""
_near = lambda n: f"coalesce(abs((close - s{n}) / s{n}) * 100 <= 3.0, FALSE)"
_stat = lambda months, year: f"""WITH {sql.BARS}, r AS (SELECT *, coalesce(lag(close) OVER ({_w}), close, 0) AS prev FROM bars WHERE date >= CAST(DATE '{AS_OF}' - INTERVAL {months} MONTH AS DATE)),
 l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
 y AS (SELECT symbol, coalesce(max(nullif(high, 0)), 0) AS high_52w, coalesce(min(low), 0) AS low_52w FROM (SELECT * FROM {year} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 252) GROUP BY 1)
 SELECT l.symbol, date, close, prev, floor((close - prev) * 100 + 0.5) / 100 AS change, floor(CASE WHEN prev > 0 THEN (close - prev) / prev * 100 ELSE 0 END * 100 + 0.5) / 100 AS change_pct, high_52w, low_52w FROM l LEFT JOIN y USING (symbol)"""  # noqa: E731
_rma = lambda x, n: f"""(SELECT symbol, i, avg(x) AS v FROM (SELECT symbol, {n} AS i, {x} AS x FROM t WHERE {x} IS NOT NULL QUALIFY row_number() OVER ({_w}) <= {n}) GROUP BY 1, 2 HAVING count(*) = {n})"""


def _wilder(name: str, x: str, n: int) -> str:
    """Recursive smoothing of column x of table t (symbol, i, ...), from the mean of its first n values."""
    first = f"SELECT symbol, i, {x} FROM t WHERE {x} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i) <= {n}"
    seed = f"SELECT symbol, CAST(max(i) AS BIGINT) AS i, avg({x}) AS v FROM ({first}) GROUP BY 1 HAVING count(*) = {n}"
    return f"{name} AS ({seed} UNION ALL SELECT {name}.symbol, t.i, {name}.v + (t.{x} - {name}.v) / {n} FROM {name} JOIN t ON t.symbol = {name}.symbol AND t.i = {name}.i + 1)"


def _moves(c: str) -> str:
    step = f"({c} - lag({c}) OVER ({_w}))"
    return f"greatest({step}, 0) + {step} * 0 AS up, greatest(-{step}, 0) + {step} * 0 AS down"


_rsi = lambda u, d: f"CASE WHEN {d}.v = 0 THEN 100.0 WHEN {u}.v = 0 THEN 0.0 ELSE 100 - 100 / (1 + {u}.v / {d}.v) END"
_at = lambda *names: " ".join(f"LEFT JOIN {n} ON {n}.symbol = t.symbol AND {n}.i = t.i" for n in names)
_lag = lambda c, n=1: f"lag({c}, {n}) OVER ({_w})"
_mean = lambda c, n: f"CASE WHEN count({c}) OVER ({_w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg({c}) OVER ({_w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
_signals = f"""WITH RECURSIVE {sql.BARS}, {_bench}, j AS (SELECT b.*, n.bench FROM bars b ASOF LEFT JOIN bench n ON b.date >= n.date),
 a1 AS (SELECT *, close / bench AS rs FROM j), a2 AS (SELECT *, (rs / ({_mean('rs', 144)}) - 1) * 100 AS strength FROM a1), a3 AS (SELECT *, {_mean('strength', 60)} AS average FROM a2),
 t AS (SELECT *, row_number() OVER ({_w}) AS i, greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')})) AS tr FROM a3), {_wilder('atr', 'tr', 14)},
 b1 AS (SELECT t.*, atr.v AS atr FROM t LEFT JOIN atr ON atr.symbol = t.symbol AND atr.i = t.i), b2 AS (SELECT *, 6 * (atr / ({_mean('atr', 100)})) AS threshold, abs(strength - average) AS diff FROM b1),
 b3 AS (SELECT *, CASE WHEN strength > average THEN CASE WHEN diff > threshold * 1.5 THEN 'Strong Bull' WHEN diff > threshold THEN 'Mild Bull' ELSE 'Neutral' END ELSE CASE WHEN diff > threshold * 1.5 THEN 'Strong Bear' WHEN diff > threshold THEN 'Mild Bear' ELSE 'Neutral' END END AS zone FROM b2),
 s AS (SELECT *, {_lag('close', 40)} AS p40, {_full('max(high)', 40)} AS h40, {_full('avg(volume)', 20)} AS v20, {_full('avg(close)', 21)} AS s21, {_full('avg(close)', 50)} AS s50, {_full('avg(close)', 200)} AS s200 FROM b3),
 m AS (SELECT *, CASE WHEN p40 > 0 THEN (close - p40) / p40 * 100 ELSE 0 END >= 100 AS emd, CASE WHEN h40 > 0 THEN (h40 - close) / h40 * 100 ELSE 0 END BETWEEN 0 AND 20 AS ca, coalesce(volume >= v20 * 1.5, FALSE) AND ({_near(21)} OR {_near(50)} OR {_near(200)}) AS vmac, coalesce(strength > average, FALSE) AS bull, coalesce(diff > threshold, FALSE) AS far, {_lag('strength', 5)} AS back FROM s),
 g AS (SELECT *, CAST(emd AS BIGINT) + CAST(ca AS BIGINT) + CAST(vmac AS BIGINT) AS score, CASE WHEN bull AND emd THEN 2 ELSE 0 END + CASE WHEN bull AND ca THEN 1 ELSE 0 END + CASE WHEN vmac THEN 1 ELSE 0 END AS agreement FROM m)
 SELECT symbol, date, round_even(strength, 4) AS strength, round_even(average, 4) AS average, round_even(threshold, 4) AS threshold, round_even(abs(strength - back), 4) AS momentum, zone,
 CAST(CASE zone WHEN 'Strong Bull' THEN 2 WHEN 'Mild Bull' THEN 1 WHEN 'Strong Bear' THEN -2 WHEN 'Mild Bear' THEN -1 ELSE 0 END AS BIGINT) AS zone_value, CAST(agreement AS BIGINT) AS agreement,
 CASE WHEN agreement >= 4 THEN 'Excellent' WHEN agreement >= 3 THEN 'Strong' WHEN agreement >= 2 THEN 'Moderate' ELSE 'Weak' END AS agreement_status,
 CASE WHEN bull AND score >= 3 AND far THEN 'Perfect Entry' WHEN bull AND score >= 2 AND diff > threshold * 0.5 THEN 'Strong Entry' WHEN NOT bull AND score <= 1 THEN 'Caution/Exit' ELSE 'Wait' END AS signal,
 CASE WHEN strength > back THEN 'Up' WHEN strength < back THEN 'Down' ELSE 'Flat' END AS direction, CASE WHEN abs(strength - back) > 2 THEN 'Strong' WHEN abs(strength - back) > 1 THEN 'Moderate' ELSE 'Weak' END AS momentum_label,
 CAST(zone = 'Strong Bull' AS INTEGER) AS is_strong_bull, CAST(zone = 'Mild Bull' AS INTEGER) AS is_mild_bull, CAST(zone = 'Strong Bear' AS INTEGER) AS is_strong_bear, CAST(zone = 'Mild Bear' AS INTEGER) AS is_mild_bear, CAST(zone = 'Neutral' AS INTEGER) AS is_neutral,
 coalesce(strength > average AND {_lag('strength')} <= {_lag('average')} OR strength < average AND {_lag('strength')} >= {_lag('average')}, FALSE) AS crossed, coalesce(far AND {_lag('diff')} <= threshold, FALSE) AS moved_far, coalesce(zone <> {_lag('zone')}, FALSE) AS zone_changed, coalesce(score >= 3 AND {_lag('score')} < 3, FALSE) AS perfect, bull AND score >= 3 AND far AS ultimate FROM g"""
_spread = f"""WITH RECURSIVE {sql.BARS}, s AS (SELECT *, {_full('avg(close)', 10)} - {_full('avg(close)', 40)} AS spread FROM bars),
 t AS (SELECT *, row_number() OVER ({_w}) AS i, {_moves('spread')}, greatest(close - {_lag('close')}, 0) + (close - {_lag('close')}) * 0 AS cup, greatest({_lag('close')} - close, 0) + (close - {_lag('close')}) * 0 AS cdown FROM s),
 {_wilder('u', 'up', 5)}, {_wilder('d', 'down', 5)}, {_wilder('u14', 'cup', 14)}, {_wilder('d14', 'cdown', 14)},
 x AS (SELECT t.*, {_rsi('u', 'd')} AS rs, {_rsi('u14', 'd14')} AS rsi FROM t {_at('u', 'd', 'u14', 'd14')}), y AS (SELECT *, {_mean('rs', 3)} AS smooth FROM x),
 z AS (SELECT *, smooth > greatest(0, coalesce(max(smooth) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS new_high, smooth > {_full('max(smooth)', 40, 1)} AS range_high, close < {_full('max(close)', 40)} AS below FROM y)
 SELECT symbol, date, new_high, range_high, new_high AND below AS new_high_before_price, range_high AND below AS range_high_before_price,
 {_full('max(high)', 14)} = high AND rsi < {_full('max(rsi)', 14)} AS bearish, {_full('min(low)', 14)} = low AND rsi > {_full('min(rsi)', 14)} AS bullish FROM z"""
SQL = {
    "k19_signals": _signals, "k16_new_highs": _spread,
    "k24_oscillators": f"""WITH RECURSIVE {sql.BARS}, t AS (SELECT symbol, date, row_number() OVER ({_w}) AS i, {_moves('close')} FROM bars),
 {_wilder('u9', 'up', 9)}, {_wilder('d9', 'down', 9)}, {_wilder('u4', 'up', 4)}, {_wilder('d4', 'down', 4)},
 x AS (SELECT t.symbol, t.date, {_rsi('u9', 'd9')} AS r9, {_rsi('u4', 'd4')} AS r4 FROM t {_at('u9', 'd9', 'u4', 'd4')})
 SELECT symbol, date, round_even(CASE WHEN r9 IS NOT NULL THEN least(greatest(1.5 * (r9 - 61), 0), 50) END, 4) AS banker, round_even(CASE WHEN r4 IS NOT NULL THEN least(greatest(r4 - 15, 0), 50) END, 4) AS hot_money, round_even(r9 / 2, 4) AS line FROM x""",
    "k16_momentum_spread": f"""WITH RECURSIVE {sql.BARS}, s AS (SELECT *, {_full('avg(close)', 10)} - {_full('avg(close)', 40)} AS spread FROM bars),
 t AS (SELECT symbol, date, spread, row_number() OVER ({_w}) AS i, {_moves('spread')} FROM s), {_wilder('u', 'up', 5)}, {_wilder('d', 'down', 5)},
 x AS (SELECT t.symbol, t.date, spread, {_rsi('u', 'd')} AS rs FROM t {_at('u', 'd')})
 SELECT symbol, date, round_even(spread, 3) AS spread, round_even(rs, 3) AS rs, round_even(CASE WHEN count(rs) OVER ({_w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN avg(rs) OVER ({_w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 3) AS smooth FROM x""",
    "d01_market_daily": f"WITH {sql.RET} SELECT * FROM ret",
    "d04_trimmed_daily": f"WITH {sql.RET} SELECT symbol, date, round_even(open, 2) AS open, round_even(high, 2) AS high, round_even(low, 2) AS low, round_even(close, 2) AS close, volume, daily_return, gap_pct, daily_range_pct FROM ret QUALIFY row_number() OVER ({_w}) > 1",
    "s14_calendar": f"WITH {sql.CAL} SELECT date FROM cal",
    "s15_event_bars": "SELECT event_type, CAST(ts AS DATE) AS date, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    "a01_baseline": f"WITH {sql.RET} SELECT symbol, n, round_even(down, 4) AS down, round_even(mean, 5) AS mean, round_even(reach, 5) AS reach FROM (SELECT symbol, {sql.STATS} FROM ret WHERE daily_return IS NOT NULL GROUP BY 1)",
    "a04_symbol_summary": f"WITH {sql.BARS} SELECT symbol, count(*) AS n, min(date) AS first, max(date) AS last, min(close) AS least, max(close) AS most FROM bars GROUP BY 1",
    "a05_totals": f"WITH {sql.BARS} SELECT count(DISTINCT symbol) AS symbols, count(*) AS n, min(date) AS first, max(date) AS last FROM bars",
    "o02_busiest_years": f"WITH {sql.BARS} SELECT symbol, CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM bars GROUP BY 1, 2 ORDER BY n DESC, symbol, year LIMIT 10",
    "n11_windows": f"WITH {sql.BARS} SELECT symbol, date, round_even({_full('avg(close)', 20)}, 5) AS sma20, {_full('max(high)', 20)} AS high20, {_full('min(low)', 20)} AS low20, {_full('max(high)', 20, 1)} AS high20_before, lag(close, 5) OVER ({_w}) AS close5, lag(close, 40) OVER ({_w}) AS close40, close > greatest(0, coalesce(max(close) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS new_high FROM bars",
    "n22_runs": f"""WITH {sql.BARS}, a AS (SELECT *, close > average AS above, coalesce(close > average AND {_lag('close')} <= {_lag('average')} OR close < average AND {_lag('close')} >= {_lag('average')}, FALSE) AS crossed FROM (SELECT *, {_full('avg(close)', 20)} AS average FROM bars)),
 c AS (SELECT *, above <> {_lag('above')} AS x FROM a WHERE average IS NOT NULL), g AS (SELECT *, sum(CASE WHEN coalesce(x, TRUE) THEN 1 ELSE 0 END) OVER ({_w}) AS island FROM c)
 SELECT symbol, date, above, crossed, row_number() OVER (PARTITION BY symbol, island ORDER BY date) AS duration, row_number() OVER (PARTITION BY symbol, island ORDER BY date) - 1 AS stability FROM g""",
    "n16_smoothed": f"""WITH RECURSIVE {sql.BARS}, t AS (SELECT symbol, date, row_number() OVER ({_w}) AS i, greatest(close - lag(close) OVER ({_w}), 0) + (close - lag(close) OVER ({_w})) * 0 AS up, greatest(lag(close) OVER ({_w}) - close, 0) + (close - lag(close) OVER ({_w})) * 0 AS down,
 greatest(high - low, abs(high - lag(close) OVER ({_w})), abs(low - lag(close) OVER ({_w}))) AS tr FROM bars),
 u AS (SELECT symbol, CAST(i + 1 AS BIGINT) AS i, v FROM {_rma('up', 9)} UNION ALL SELECT u.symbol, t.i, u.v + (t.up - u.v) / 9 FROM u JOIN t ON t.symbol = u.symbol AND t.i = u.i + 1),
 d AS (SELECT symbol, CAST(i + 1 AS BIGINT) AS i, v FROM {_rma('down', 9)} UNION ALL SELECT d.symbol, t.i, d.v + (t.down - d.v) / 9 FROM d JOIN t ON t.symbol = d.symbol AND t.i = d.i + 1),
 r AS (SELECT symbol, CAST(i AS BIGINT) AS i, v FROM {_rma('tr', 14)} UNION ALL SELECT r.symbol, t.i, r.v + (t.tr - r.v) / 14 FROM r JOIN t ON t.symbol = r.symbol AND t.i = r.i + 1)
 SELECT t.symbol, t.date, round_even(CASE WHEN d.v = 0 THEN 100.0 WHEN u.v = 0 THEN 0.0 ELSE 100 - 100 / (1 + u.v / d.v) END, 4) AS rsi, round_even(r.v, 4) AS atr
 FROM t LEFT JOIN u ON u.symbol = t.symbol AND u.i = t.i LEFT JOIN d ON d.symbol = t.symbol AND d.i = t.i LEFT JOIN r ON r.symbol = t.symbol AND r.i = t.i""",
    "k18_screens": f"""WITH {sql.BARS}, s AS (SELECT *, lag(close, 40) OVER ({_w}) AS p40, {_full('max(high)', 40)} AS h40, {_full('avg(volume)', 20)} AS v20, {_full('avg(close)', 21)} AS s21, {_full('avg(close)', 50)} AS s50, {_full('avg(close)', 200)} AS s200 FROM bars),
 m AS (SELECT symbol, date, CASE WHEN p40 > 0 THEN (close - p40) / p40 * 100 ELSE 0 END AS moved, CASE WHEN h40 > 0 THEN (h40 - close) / h40 * 100 ELSE 0 END AS corrected, coalesce(volume >= v20 * 1.5, FALSE) AND ({_near(21)} OR {_near(50)} OR {_near(200)}) AS vmac FROM s),
 z AS (SELECT *, moved >= 100 AS emd, corrected BETWEEN 0 AND 20 AS ca FROM m)
 SELECT symbol, date, round_even(moved, 4) AS moved, round_even(corrected, 4) AS corrected, emd, ca, vmac, CAST(emd AS BIGINT) + CAST(ca AS BIGINT) + CAST(vmac AS BIGINT) AS score, ['Weak', 'Partial', 'Strong', 'Perfect'][CAST(emd AS BIGINT) + CAST(ca AS BIGINT) + CAST(vmac AS BIGINT) + 1] AS status FROM z""",
    "j13_aligned_strength": f"""WITH {sql.BARS}, {_bench}, j AS (SELECT b.symbol, b.date, close, n.bench FROM bars b ASOF LEFT JOIN bench n ON b.date >= n.date),
 r AS (SELECT *, close / bench AS rs FROM j) SELECT symbol, date, bench, round_even((rs / CASE WHEN count(rs) OVER ({_w} ROWS BETWEEN 143 PRECEDING AND CURRENT ROW) = 144 THEN avg(rs) OVER ({_w} ROWS BETWEEN 143 PRECEDING AND CURRENT ROW) END - 1) * 100, 4) AS strength FROM r""",
    "n24_intraday_bars": f"WITH {_intraday} SELECT * FROM intra",
    # a new interval begins where its start is not that of the bar before; the extremes are over as many bars as the interval has minutes
    "k25_interval_extremes": f"""WITH {_intraday}, j AS (SELECT b.symbol, b.time, b.close, n.close AS bench FROM intra b ASOF LEFT JOIN (SELECT * FROM intra WHERE symbol = 'view') n ON b.time >= n.time),
 r AS (SELECT *, close / bench AS rs FROM j), m AS (SELECT *, (rs / CASE WHEN count(rs) OVER ({_t} ROWS BETWEEN 143 PRECEDING AND CURRENT ROW) = 144 THEN avg(rs) OVER ({_t} ROWS BETWEEN 143 PRECEDING AND CURRENT ROW) END - 1) * 100 AS strength FROM r)
 SELECT symbol, time, bench, round_even(strength, 4) AS strength, """ + ", ".join(
        f"coalesce(time_bucket(INTERVAL {n} MINUTE, time) <> lag(time_bucket(INTERVAL {n} MINUTE, time)) OVER ({_t}) AND strength = CASE WHEN count(*) OVER ({_t} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {f}(strength) OVER ({_t} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END, FALSE) AS {k}_{n}"
        for n in (60, 120, 240)
        for k, f in (("high", "max"), ("low", "min"))
    )
    + " FROM m",
    "k15_chart_rows": f"WITH {sql.RET} SELECT * REPLACE (coalesce(open, 0) AS open, coalesce(high, 0) AS high, coalesce(low, 0) AS low, coalesce(close, 0) AS close) FROM ret WHERE date >= CAST(DATE '{AS_OF}' - INTERVAL 12 MONTH AS DATE) QUALIFY row_number() OVER ({_w}) <= 10000",
    "k15_statistics": _stat(12, f"bars WHERE date <= DATE '{AS_OF}'"),
    "k15_statistics_ranged": _stat(1, "r"),
    "d27_axis": f"WITH {sql.BARS}, a AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY 1) SELECT symbol, CAST(floor(lo - p) AS BIGINT) AS axis_low, CAST(ceil(hi + p) AS BIGINT) AS axis_high FROM (SELECT *, CASE WHEN hi > lo THEN (hi - lo) * 0.05 ELSE 100.0 END AS p FROM a)",
    "n09_down_sampled": f"WITH {sql.BARS} SELECT * EXCLUDE (n, i) FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER ({_w}) - 1 AS i FROM bars) WHERE n <= 500 OR i % CAST(ceil(n / 500.0) AS BIGINT) = 0 OR i = n - 1",
    "n08_last_rows": f"WITH {sql.BARS} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 252",
}

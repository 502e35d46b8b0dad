"""Queries on positions, events, factors and risk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.rounding import rounded

from orrery.functions import rules
from orrery.operators import factors, risk, series, sky
from orrery.plans import sql, trade_sky
from orrery.sources import market


def bars(spark: SparkSession, d: str) -> DataFrame:
    return series.with_returns(market.trade_bars(market.table(spark, d, "lineitem")))


def positions(spark: SparkSession, d: str) -> DataFrame:
    return market.positions(trade_sky.raw_positions(market.table(spark, d, "lineitem")))


def moon(spark: SparkSession, d: str) -> DataFrame:
    return market.moon_intraday(trade_sky.raw_moon(market.table(spark, d, "lineitem")))


def aspects(spark: SparkSession, d: str) -> DataFrame:
    return sky.aspects(positions(spark, d))


def events(spark: SparkSession, d: str) -> DataFrame:
    return sky.events(positions(spark, d))


def factor_dates(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d)
    return factors.given().dates({"positions": p, "aspects": sky.aspects(p), "moon": moon(spark, d)})


def day_factors(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d)
    return risk.day_factors(market.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct(), p, sky.aspects(p), moon(spark, d))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return risk.risk_scores(day_factors(spark, d))


def k05(spark: SparkSession, d: str) -> DataFrame:
    df = day_factors(spark, d)
    pairs = [c for c, t in df.dtypes if t.startswith("struct")]
    return df.withColumns({c: F.col(c)["orb"] for c in pairs})


def k10(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).drop("explanation")


def d21(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("date", "explanation")


def factor_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sums of large returns differ in the last digits by order, so the query shows fewer."""
    out = risk.factor_stats(bars(spark, d), factor_dates(spark, d))
    return out.withColumns({c: rounded(c, 2) for c in ("avg_return", "avg_range_pct", "baseline_avg_return")})


def a17(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    return s.agg(F.count("*").alias("n"), rounded(F.avg("composite_score"), 3).alias("mean"), F.min("composite_score").alias("least"), F.max("composite_score").alias("most"))


def top_days(spark: SparkSession, d: str) -> DataFrame:
    """The ten highest scores, earlier days first, with the return of one symbol on the day."""
    top = scores(spark, d).select("date", "composite_score", "regime").orderBy(F.desc("composite_score"), "date").limit(10)
    own = bars(spark, d).where("symbol = 'N'").select("date", "daily_return")
    return F.broadcast(top).join(own, "date", "left")  # ten rows


def retro_days(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d)
    return p.groupBy("planet").agg(F.sum(F.col("retrograde").cast("bigint")).alias("days"), rounded(F.avg(F.when(F.col("retrograde"), 100.0).otherwise(0.0)), 3).alias("pct")).where("days > 0")


def aspect_counts(spark: SparkSession, d: str) -> DataFrame:
    return aspects(spark, d).groupBy("planet_1", "planet_2", "aspect_type").agg(F.count("*").alias("n"), F.sum(F.col("exact").cast("bigint")).alias("exact_n"))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("planet").pivot("event_type", ["nakshatra_change", "sign_change", "retrograde_start", "retrograde_end"]).count().fillna(0)


def stations(spark: SparkSession, d: str) -> DataFrame:
    """Stations detected again and appended; the same event is kept once."""
    found = events(spark, d)
    return found.unionByName(found.where("event_type like 'retrograde%'")).distinct().where("event_type like 'retrograde%'")


def table_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A10: rows and dates of each table."""
    out = None
    for name, df, c in (("positions", positions(spark, d), "date"), ("aspects", aspects(spark, d), "date"), ("events", events(spark, d), "event_date"), ("moon", moon(spark, d), "date")):
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.min(c).alias("first"), F.max(c).alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


def gandanta_days(spark: SparkSession, d: str) -> DataFrame:
    return moon(spark, d).where("gandanta").agg(F.countDistinct("date").alias("n"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """What the score's displays say on each day of each symbol."""
    both = bars(spark, d).select("symbol", "date", "daily_return").join(scores(spark, d).select("date", "composite_score"), "date")
    s = F.col("composite_score")
    return both.select("symbol", "date", rules.display_regime(s).alias("shown"), rules.band(s).alias("band"), rules.volatility_label(s).alias("volatility"), F.coalesce(rules.was_right(s, F.col("daily_return")), F.lit(False)).alias("right"))


def outlook(spark: SparkSession, d: str) -> DataFrame:
    """Seven days from the first scored one."""
    s = scores(spark, d).select("date", "composite_score", "regime")
    start = s.agg(F.min("date").alias("a")).select(F.explode(F.expr("sequence(a, date_add(a, 6))")).alias("date"))
    return F.broadcast(start).join(s, "date", "left").withColumn("weekday", F.date_format("date", "EEE"))  # seven rows


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Nested day reports with each symbol's reaction."""
    b = bars(spark, d).groupBy("date").agg(F.sort_array(F.collect_list(F.struct("symbol", "daily_return"))).alias("impacts"))
    return scores(spark, d).select("date", "composite_score", F.struct(*risk.DIMENSIONS).alias("factors"), "regime", "explanation").join(b, "date")


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """K29, a row for each symbol of a day's report."""
    out = reports(spark, d).withColumn("i", F.explode("impacts"))
    return out.select("date", "composite_score", "factors.*", "regime", "explanation", "i.symbol", "i.daily_return")


def moon_changes(spark: SparkSession, d: str) -> DataFrame:
    return sky.event_dates(events(spark, d), "nakshatra_change", "Moon", "Moon Nakshatra Change")


def transitions(spark: SparkSession, d: str) -> DataFrame:
    return sky.speed_transitions(positions(spark, d).where("planet = 'Mercury'"))


QUERIES = {
    "f06_moon_changes": moon_changes, "n06_speed_transitions": transitions,
    "k01_positions": positions, "k02_aspects": aspects, "k03_events": events, "k04_moon_intraday": moon, "k05_day_factors": k05,
    "k10_risk_scores": k10, "d21_explanation": d21, "k12_factor_dates": factor_dates,
    "a02_factor_stats": factor_stats, "k13_report": lambda s, d: risk.report(factor_stats(s, d)),
    "a15_regime_distribution": lambda s, d: risk.regime_distribution(scores(s, d)), "a16_histogram": lambda s, d: risk.histogram(scores(s, d)), "a17_score_summary": a17,
    "a18_cohorts": lambda s, d: risk.cohorts(scores(s, d), bars(s, d)), "n10_top_days": top_days,
    "a07_retrograde_days": retro_days, "a08_aspect_counts": aspect_counts, "a20_event_counts": event_counts, "n05_stations": stations, "a10_table_ranges": table_ranges, "a06_gandanta_days": gandanta_days,
    "d19_labels": labels, "k27_outlook": outlook, "k29_reports": reports, "k29_report_rows": report_rows,
}

_dims = "date, composite_score, structural, momentum, volatility, deception, regime"
_base = f"(SELECT symbol, {sql.STATS} FROM ret WHERE daily_return IS NOT NULL GROUP BY 1)"
_stats = f"""stats AS (SELECT f.factor AS factor_type, f.symbol AS index_symbol, round_even(f.down, 2) AS pct_down_days, round_even(f.mean, 4) AS avg_return, round_even(f.reach, 4) AS avg_range_pct,
 round_even(CASE WHEN b.reach > 0 THEN f.reach / b.reach ELSE 1.0 END, 2) AS volatility_multiplier, f.n AS sample_count, round_even(b.down, 2) AS baseline_down_pct, round_even(b.mean, 4) AS baseline_avg_return
 FROM (SELECT symbol, factor, {sql.STATS} FROM ret JOIN fac USING (date) WHERE daily_return IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5) f JOIN {_base} b ON b.symbol = f.symbol)"""
_count = lambda kind: f"count(*) FILTER (event_type = '{kind}') AS {kind}"
SQL = {
    "k29_report_rows": f"{sql.ALL}{sql.TEXT} SELECT r.date, composite_score, structural, momentum, volatility, deception, regime, explanation, ret.symbol, ret.daily_return FROM risk r JOIN said ON said.date = r.date JOIN ret ON ret.date = r.date",
    "d21_explanation": f"{sql.ALL}{sql.TEXT} SELECT date, explanation FROM said",
    "f06_moon_changes": f"WITH {sql.POS}{sql.EVT} SELECT DISTINCT 'Moon Nakshatra Change' AS factor, event_date AS date FROM evt WHERE event_type = 'nakshatra_change' AND planet = 'Moon'",
    "n06_speed_transitions": f"WITH {sql.POS} SELECT planet, date, CASE WHEN speed < 0 THEN 'DIRECT to RETRO' ELSE 'RETRO to DIRECT' END AS direction, old_speed, speed FROM (SELECT *, lag(speed) OVER (ORDER BY date) AS old_speed FROM (SELECT * FROM pos WHERE planet = 'Mercury' ORDER BY date LIMIT 1000)) WHERE (old_speed < 0) <> (speed < 0)",
    "k01_positions": f"WITH {sql.POS} SELECT * FROM pos",
    "k02_aspects": f"WITH {sql.POS}{sql.ASP} SELECT * FROM asp",
    "k03_events": f"WITH {sql.POS}{sql.EVT} SELECT * FROM evt",
    "k04_moon_intraday": f"WITH {sql.POS}{sql.MOON} SELECT * FROM moon",
    "k05_day_factors": f"{sql.ALL} SELECT * FROM day",
    "k10_risk_scores": f"{sql.ALL} SELECT {_dims} FROM risk",
    "k12_factor_dates": f"WITH {sql.POS}{sql.MOON}{sql.ASP}{sql.FAC} SELECT * FROM fac",
    "a02_factor_stats": f"{sql.ALL}, {_stats} SELECT * REPLACE (round_even(avg_return, 2) AS avg_return, round_even(avg_range_pct, 2) AS avg_range_pct, round_even(baseline_avg_return, 2) AS baseline_avg_return) FROM stats",
    "k13_report": f"{sql.ALL}, {_stats} SELECT factor_type, index_symbol, pct_down_days, sample_count, CASE WHEN pct_down_days - baseline_down_pct > 3 THEN 'BEARISH' WHEN pct_down_days - baseline_down_pct < -3 THEN 'BULLISH' ELSE 'NEUTRAL' END AS signal FROM stats",
    "a15_regime_distribution": f"{sql.ALL} SELECT CAST(place AS BIGINT) AS place, v.regime, coalesce(n, 0) AS n, round_even(coalesce(n, 0) * 100.0 / greatest((SELECT count(*) FROM risk), 1), 2) AS pct FROM (VALUES {', '.join(f'({i}, {r!r})' for i, r in enumerate(rules.REGIMES))}) v(place, regime) LEFT JOIN (SELECT regime, count(*) AS n FROM risk GROUP BY 1) c ON c.regime = v.regime",
    "a16_histogram": f"{sql.ALL} SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, count(composite_score) AS n FROM (VALUES {', '.join(f'({0 if i == 0 else 10 * i + 1}, {10 * i + 10})' for i in range(10))}) v(lo, hi) LEFT JOIN risk ON composite_score BETWEEN lo AND hi GROUP BY 1, 2",
    "a17_score_summary": f"{sql.ALL} SELECT count(*) AS n, round_even(avg(composite_score), 3) AS mean, min(composite_score) AS least, max(composite_score) AS most FROM risk",
    "a18_cohorts": f"{sql.ALL} SELECT symbol, CAST(threshold AS INTEGER) AS threshold, count(*) AS n, round_even(avg(CASE WHEN daily_return < 0 THEN 100.0 ELSE 0.0 END), 2) AS down_pct, round_even(avg(daily_return), 4) AS avg_return FROM ret JOIN risk USING (date) JOIN (VALUES (0), (50), (60), (70)) t(threshold) ON composite_score >= threshold WHERE daily_return IS NOT NULL GROUP BY 1, 2",
    "n10_top_days": f"{sql.ALL}, top AS (SELECT date, composite_score, regime FROM risk ORDER BY composite_score DESC, date LIMIT 10) SELECT top.*, daily_return FROM top LEFT JOIN (SELECT * FROM ret WHERE symbol = 'N') r USING (date)",
    "a07_retrograde_days": f"WITH {sql.POS} SELECT planet, CAST(sum(CASE WHEN retrograde THEN 1 ELSE 0 END) AS BIGINT) AS days, round_even(avg(CASE WHEN retrograde THEN 100.0 ELSE 0.0 END), 3) AS pct FROM pos GROUP BY 1 HAVING bool_or(retrograde)",
    "a08_aspect_counts": f"WITH {sql.POS}{sql.ASP} SELECT planet_1, planet_2, aspect_type, count(*) AS n, CAST(sum(CASE WHEN exact THEN 1 ELSE 0 END) AS BIGINT) AS exact_n FROM asp GROUP BY 1, 2, 3",
    "a20_event_counts": f"WITH {sql.POS}{sql.EVT} SELECT planet, {', '.join(map(_count, ('nakshatra_change', 'sign_change', 'retrograde_start', 'retrograde_end')))} FROM evt GROUP BY 1",
    "n05_stations": f"WITH {sql.POS}{sql.EVT} SELECT DISTINCT * FROM evt WHERE event_type LIKE 'retrograde%'",
    "a10_table_ranges": f"WITH {sql.POS}{sql.MOON}{sql.ASP}{sql.EVT} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, min({c}) AS first, max({c}) AS last FROM {t}" for n, t, c in (("positions", "pos", "date"), ("aspects", "asp", "date"), ("events", "evt", "event_date"), ("moon", "moon", "date"))),
    "a06_gandanta_days": f"WITH {sql.POS}{sql.MOON} SELECT count(DISTINCT date) AS n FROM moon WHERE gandanta",
    "d19_labels": f"{sql.ALL} SELECT symbol, date, CASE WHEN composite_score >= 71 THEN 'Capital Protection' WHEN composite_score >= 51 THEN 'Distribution' WHEN composite_score >= 31 THEN 'Expansion' ELSE 'Accumulation' END AS shown, CASE WHEN composite_score > 70 THEN 'red' WHEN composite_score > 40 THEN 'amber' ELSE 'green' END AS band, CASE WHEN composite_score > 60 THEN 'High' WHEN composite_score > 35 THEN 'Med' ELSE 'Low' END AS volatility, coalesce((composite_score > 50 AND daily_return < 0) OR (composite_score <= 50 AND daily_return >= 0), FALSE) AS \"right\" FROM ret JOIN risk USING (date)",
    "k27_outlook": f"{sql.ALL} SELECT s.date, composite_score, regime, strftime(s.date, '%a') AS weekday FROM (SELECT CAST(unnest(generate_series(min(date), min(date) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM risk) s LEFT JOIN risk USING (date)",
}

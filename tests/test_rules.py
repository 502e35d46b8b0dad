"""Golden vectors of the scalar rules, and properties of the composed ones."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from orrery.functions import astro, clean, rules
from orrery.operators import bridges, charts, indicators, series, sky, upsert
import sample_sky
from orrery.sources import market


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", expr(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


def test_aspects(spark):
    cases = [(5, 355, "conjunction", 10), (5, 354.9, None, None), (10, 188, "opposition", 2), (0, 170, "opposition", 10), (0, 98, "square", 8), (0, 98.01, None, None), (0, 112, "trine", 8), (350, 110, "trine", 0), (359.5, 0.25, "conjunction", 0.75)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b, _, _ in cases], "a double, b double")
    for row, (_, _, kind, orb) in zip(df.select(astro.aspect(astro.distance(F.col("a"), F.col("b"))).alias("x")).collect(), cases, strict=True):
        assert (row["x"]["aspect_type"], row["x"]["orb"]) == (kind, orb) if kind else row["x"] is None


def test_aspect_score(spark):
    df = spark.createDataFrame([(0.5, 10.0, True, 10.0), (1.01, 10.0, False, 9.0), (5.0, 7.0, False, 3.5), (2.5, 5.0, False, 3.8), (3.33, 8.0, False, 5.3), (10.0, 8.0, False, 0.0), (None, 8.0, None, 0.0)], "orb double, m double, e boolean, want double")
    for r in df.collect():
        one = spark.createDataFrame([(r["orb"], r["e"])], "o double, e boolean")
        assert one.select(rules.aspect_score(F.col("o"), r["m"], F.col("e")).alias("x")).first()["x"] == pytest.approx(r["want"], abs=0.1)


def test_places(spark):
    lon = [0.0, 13.3333, 13.3334, 66.7, 119.9, 239.99, 359.999]
    assert column(spark, lon, "double", astro.nakshatra) == [0, 0, 1, 5, 8, 17, 26]
    assert column(spark, lon, "double", astro.pada) == [1, 4, 1, 1, 4, 4, 4]
    assert column(spark, lon, "double", astro.sign) == [0, 0, 0, 2, 3, 7, 11]
    assert column(spark, [116.67, 116.68, 123.32, 356.7, 3.0, 3.33, 93.0], "double", astro.gandanta) == [False, True, True, True, True, False, False]
    assert column(spark, ["Ashvini", "Tauras", "Other", None], "string", astro.canonical) == ["Ashwini", "Taurus", "Other", None]


def test_labels(spark):
    assert column(spark, [30.0, 30.1, 50.0, 50.1, 70.0, 70.1], "double", rules.regime) == ["Accumulation", "Expansion", "Expansion", "Distribution", "Distribution", "Capital Protection"]
    df = spark.createDataFrame([(51.0, -0.1), (50.0, 0.0), (50.0, -0.1), (51.0, 0.0)], "s double, r double")
    assert [r[0] for r in df.select(rules.was_right(F.col("s"), F.col("r"))).collect()] == [True, True, False, False]
    assert column(spark, ["ab", ""], "string", rules.string_hash)[0] == 97 * 31 + 98


def test_parsing(spark):
    text = ["23,14,52,935", "-", "0", "NaN", "", None, "x"]
    assert column(spark, text, "string", clean.parse_indian) == [231452935.0, None, 0.0, None, None, None, None]
    assert column(spark, text, "string", clean.parse_float) == [231452935.0, None, None, None, None, None, None]
    assert column(spark, ["7.9", "0", "NaN", "-2.5"], "string", clean.parse_int) == [7, 0, None, -2]
    assert column(spark, ["31-12-1999", "31-02-1999", None], "string", clean.parse_date) == [date(1999, 12, 31), None, None]
    assert column(spark, [1.0, float("nan"), float("inf"), None], "double", clean.finite) == [1.0, None, None, None]


def bars(spark, closes, symbol="A"):
    rows = [(symbol, date.fromordinal(730000 + i), float(c), float(c) + 1, float(c) - 1, float(c), 100) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume bigint")


def test_returns_and_windows(spark):
    df = series.with_returns(bars(spark, [200, 210])).orderBy("date").collect()
    assert [r["daily_return"] for r in df] == [None, 5.0]
    w = series.by("symbol")
    got = bars(spark, [1, 2, 3, 4]).select("date", series.sma("close", w, 3).alias("x"), series.highest("close", w, 2, 1).alias("y")).orderBy("date").collect()
    assert [r["x"] for r in got] == [None, None, 2.0, 3.0]
    assert [r["y"] for r in got] == [None, None, 2.0, 3.0]


def test_smoothing_against_a_loop(spark):
    closes = [10, 11, 10.5, 12, 13, 12.5, 12.4, 14, 13.7, 13.9, 15]
    got = [r["rsi"] for r in series.with_rsi(bars(spark, closes), "close", 3, "rsi").orderBy("date").collect()]
    up = [max(b - a, 0) for a, b in zip(closes, closes[1:])]
    down = [max(a - b, 0) for a, b in zip(closes, closes[1:])]
    u, d = sum(up[:3]) / 3, sum(down[:3]) / 3
    want = [None, None, None]
    for i in range(2, len(up)):
        if i > 2:
            u, d = u + (up[i] - u) / 3, d + (down[i] - d) / 3
        want.append(100 - 100 / (1 + u / d))
    assert got[:3] == want[:3]
    assert all(math.isclose(a, b) for a, b in zip(got[3:], want[3:], strict=True))


def test_indicators_run(spark):
    df = bars(spark, [100 + 10 * math.sin(i / 7) + i / 5 for i in range(260)])
    bench = df.select("date", F.lit(50.0).alias("bench")).where("day(date) % 2 = 0")
    out = indicators.signals(indicators.screens(indicators.relative_strength(df, bench)))
    assert out.count() == 260
    assert out.where("zone_value not between -2 and 2 or agreement not between 0 and 4").isEmpty()
    o = indicators.oscillators(df).where("banker is not null")
    assert o.where("banker < 0 or banker > 50 or hot_money < 0 or hot_money > 50").isEmpty()
    out = indicators.momentum_spread(df)
    assert out.count() == 260 and out.where("new_high_before_price and not new_high").isEmpty()


def test_chart(spark):
    df = bars(spark, range(1, 1201))
    as_of = date.fromordinal(730000 + 1199)
    assert charts.statistics(df, "MAX", as_of).first()["low_52w"] == 1200 - 252
    thin = series.down_sampled(df).orderBy("date").collect()
    assert [r["close"] for r in thin][:2] == [1, 4]
    assert thin[-1]["close"] == 1200


def test_events_alternate(spark):
    days = spark.sql("select explode(sequence(date'2000-01-01', date'2003-12-31')) as date")
    found = sky.events(market.positions(sample_sky.raw_positions(days))).where("event_type like 'retrograde%'").orderBy("planet", "event_date").collect()
    assert found
    for a, b in zip(found, found[1:]):
        assert a["planet"] != b["planet"] or a["event_type"] != b["event_type"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, ord int, v string")
    new = spark.createDataFrame([(2, 1, "x"), (3, 2, "y"), (3, 3, "z"), (4, 4, None)], "k int, ord int, v string")
    pick = lambda df: {r["k"]: r["v"] for r in df.collect()}
    once = upsert.insert_or_ignore(old, new, ["k"], "ord", ["v"])
    assert pick(once) == {1: "a", 2: "b", 3: "y"}
    assert pick(upsert.insert_or_ignore(once, new, ["k"], "ord", ["v"])) == pick(once)
    twice = upsert.insert_or_replace(upsert.insert_or_replace(old, new, ["k"], "ord"), new, ["k"], "ord")
    assert pick(twice) == {1: "a", 2: "x", 3: "z", 4: None}
    merged = upsert.merge_columns(old, new.select("k", "ord"), ["k"], "ord")
    assert pick(merged) == {1: "a", 2: "b", 3: None, 4: None}


def test_maps(spark):
    text = ['{"yahoo": "X"}', '"{\\"yahoo\\": \\"Y\\"}"', None]
    assert column(spark, text, "string", lambda c: F.try_element_at(bridges.vendor_map(c), F.lit("yahoo"))) == ["X", "Y", None]
    row = spark.sql("select map('a', 1, 'b', 2) as x, map('b', 3) as y").select(bridges.merged_maps(F.col("x"), F.col("y")).alias("m")).first()
    assert row["m"] == {"a": 1, "b": 3}

"""Series in blocks, and the as-of join, against loops over the whole series."""

import bisect
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import blocks, indicators, series
from orrery.operators.asof import asof_join


def smooth(values, n):
    out, seed, last = [], [], None
    for x in values:
        if x is not None:
            if last is None:
                seed.append(x)
                last = sum(seed) / n if len(seed) == n else None
            else:
                last += (x - last) / n
        out.append(last)
    return out


def table(spark, rows, kinds="symbol string, at bigint, x double, y double"):
    return spark.createDataFrame(rows, kinds).repartition(4)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = []
    for symbol, many in (("a", 2600), ("b", 499), ("c", 500), ("d", 3), (None, 1203)):
        at = 0
        for _ in range(many):
            at += rnd.choice([1, 1, 1, 2, 9000])
            out.append((symbol, at, None if rnd.random() < 0.1 else rnd.gauss(0, 5), rnd.choice([1.0, 1.0, 1.0, 1.0, 2.0]) if many != 2600 or at % 3 else 1.0))
    return out


def by_symbol(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_places(spark, rows):
    got = blocks.numbered(table(spark, rows), order="at").collect()
    for symbol, own in by_symbol(rows).items():
        assert sorted((r["at"], r["__i"], r["__p"]) for r in got if r["symbol"] == symbol) == [(r[1], i, i // blocks.SIZE) for i, r in enumerate(own)]


@pytest.mark.parametrize("n", [7, 700])
def test_frames_reach_back_over_blocks(spark, rows, n):
    df, w = blocks.haloed(blocks.numbered(table(spark, rows), order="at"), n), blocks.window()
    got = blocks.own(df.withColumns({"high": series.highest("x", w, n), "back": F.lag("at", n).over(w)})).collect()
    assert len(got) == len(rows)
    at = {(r["symbol"], r["at"]): r for r in got}
    for symbol, own in by_symbol(rows).items():
        for i, r in enumerate(own):
            seen = [q[2] for q in own[max(0, i - n + 1) : i + 1] if q[2] is not None]
            assert at[symbol, r[1]]["high"] == (max(seen) if i + 1 >= n and seen else None)
            assert at[symbol, r[1]]["back"] == (own[i - n][1] if i >= n else None)


def test_smoothing_records_and_runs(spark, rows):
    df = blocks.numbered(table(spark, rows), order="at")
    df = blocks.recursive(df, {"s2": ("x", 2), "s14": ("x", 14), "s1": ("x", 1), "s600": ("x", 600)})
    df = blocks.run_lengths(blocks.record_before(df, "x", "most"), "y", "run")
    assert not [c for c in blocks.plain(df).columns if c.startswith("__")]
    at = {(r["symbol"], r["at"]): r for r in df.collect()}
    assert len(at) == len(rows)
    for symbol, own in by_symbol(rows).items():
        want = {n: smooth([r[2] for r in own], n) for n in (1, 2, 14, 600)}
        most, run = 0.0, 0
        for i, r in enumerate(own):
            got = at[symbol, r[1]]
            for n, line in want.items():
                assert got[f"s{n}"] == (None if line[i] is None else pytest.approx(line[i], rel=1e-9, abs=1e-9))
            assert got["most"] == most
            most = max(most, r[2] or 0.0)
            run = run + 1 if i and own[i - 1][3] == r[3] else 1
            assert got["run"] == run


def test_a_run_over_many_blocks(spark):
    df = blocks.run_lengths(blocks.numbered(spark.range(2200).select(F.lit("a").alias("symbol"), F.col("id").alias("at"), (F.col("id") >= 30).alias("y")), order="at"), "y", "run")
    assert {r["at"]: r["run"] for r in df.collect()} == {i: i + 1 if i < 30 else i - 29 for i in range(2200)}


def test_one_long_series(spark):
    """A million rows of one symbol, dealt over all tasks, equal the loop; no Python runs and no frame is partitioned by the symbol alone but those over block summaries."""
    many = 1_000_000
    x = (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007 - 0.3).alias("x")
    df = spark.range(many, numPartitions=8).select(F.lit("a").alias("symbol"), F.col("id").alias("at"), x)
    placed = blocks.numbered(df, order="at")
    assert placed.select("__p").distinct().count() == many // blocks.SIZE
    out = blocks.recursive(placed, {"s": ("x", 14)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rows = out.select("at", "x", "s").toPandas().sort_values("at")
    want = smooth(rows["x"].tolist(), 14)
    assert np.allclose(rows["s"].to_numpy()[13:], want[13:], rtol=1e-9, atol=1e-9) and rows["s"].isna().sum() == 13


def test_empty_series(spark):
    df = blocks.numbered(table(spark, []), order="at")
    assert blocks.run_lengths(blocks.record_before(blocks.recursive(df, {"s": ("x", 3)}), "x", "m"), "y", "r").isEmpty()


def test_values_of_days_without_a_bar(spark):
    """Bars on the 3rd and 6th, the benchmark on the 2nd and 5th."""
    bars = spark.createDataFrame([("a", date(2020, 1, 3)), ("a", date(2020, 1, 6)), ("b", date(2020, 1, 1))], "symbol string, date date")
    bench = spark.createDataFrame([(date(2020, 1, 2), 5.0), (date(2020, 1, 5), 7.0)], "date date, bench double")
    got = {(r["symbol"], r["date"].day): r["bench"] for r in asof_join(bars, bench, "date", ["bench"]).collect()}
    assert got == {("a", 3): 5.0, ("a", 6): 7.0, ("b", 1): None}


@pytest.mark.parametrize(("salts", "width", "tolerance"), [(1, 50, None), (4, 7, None), (3, 100_000, 12)])
def test_asof_join(spark, salts, width, tolerance):
    rnd = random.Random(width)
    key = lambda: rnd.choice(["a", "a", "a", "b", "c", None])
    left = [(key(), rnd.choice([None, rnd.randrange(600), rnd.randrange(300)]), i) for i in range(400)] + [("z", 5, 400)] + [("a", 3, 401)] * 3
    right = [(key(), rnd.choice([None, rnd.randrange(500)]), rnd.choice([None, rnd.randrange(9)]), str(i)) for i in range(120)]
    right += [("a", 40, 8, "x"), ("a", 40, 8, "y"), ("b", 40, 3, "x")]
    lf = spark.createDataFrame(left, "k string, t bigint, i int").repartition(3)
    rt = spark.createDataFrame(right, "k string, t bigint, v int, w string").repartition(3)
    limit = F.lit(tolerance) if tolerance else None
    for by in (["k"], []):
        got = asof_join(lf, rt, "t", ["v", "w"], by, tolerance=limit, block=F.floor(F.col("t") / width), salts=salts, known_at="at")
        want = []
        for k, t, i in left:
            seen = sorted((r[1], r[2], r[3]) for r in right if r[1] is not None and r[2] is not None and (not by or r[0] == k and k is not None))
            at = bisect.bisect_right([r[0] for r in seen], t) if t is not None else 0
            last = seen[at - 1] if at else None
            if last and tolerance and last[0] < t - tolerance:
                last = None
            want.append((k, t, i, *(last[1:] if last else (None, None)), last[0] if last else None))
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert asof_join(lf.limit(0), rt, "t", ["v"], ["k"]).isEmpty()
    assert asof_join(lf, rt.limit(0), "t", ["v"], ["k"]).where("v is null").count() == len(left)


def test_a_touch_of_the_average_counts_when_it_is_left(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at + timedelta(hours=i), float(v)) for i, v in enumerate([1, 0, -1, 0, -1, 1, 1])], "symbol string, time timestamp, x double")
    w = series.by("symbol", order="time")
    assert [r[0] for r in df.select(indicators.crossed(F.col("x"), F.lit(0.0), w), "time").orderBy("time").collect()] == [False, False, True, False, True, True, False]


def test_extremes_at_borders(spark):
    """Half-hourly strength that rises to the 70th bar and then falls: highs count only where an hour, two or four begin."""
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=30 * i), float(min(i, 140 - i))) for i in range(140)]
    df = spark.createDataFrame(rows, "symbol string, time timestamp, strength double")
    got = indicators.interval_extremes(df).orderBy("time").collect()
    assert [i for i, r in enumerate(got) if r["high_60"]] == list(range(60, 71, 2))
    assert [i for i, r in enumerate(got) if r["low_60"]] == list(range(100, 140, 2))
    assert [i for i, r in enumerate(got) if r["low_120"]] == [i for i in range(120, 140, 4) if min(i, 140 - i) <= min(min(j, 140 - j) for j in range(i - 119, i + 1))]
    assert not any(r["high_240"] or r["low_240"] for r in got)

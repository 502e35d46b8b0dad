"""Streams: bar-by-bar state against the batch query, partial upserts against merges of whole tables."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators import blocks, indicators, upsert
from orrery.operators import series as s
from orrery.streaming import bar_state, partial_upserts

SIZES = {"long": 10, "ma": 6, "atr": 4, "atr_ma": 9}
SCHEMA = "symbol string, time timestamp, high double, low double, close double, bench double"
START = datetime(2024, 1, 1)


def bars():
    rnd, out = random.Random(6), []
    for symbol in ("a", "b"):
        price = 100.0
        for i in range(90):
            price *= 1 + rnd.gauss(0, 0.03)
            if rnd.random() < 0.9:
                out.append((symbol, START + timedelta(minutes=30 * i), price * 1.01, price * 0.98, price, 50.0 + rnd.random() if i % 17 else None))
    return sorted(out, key=lambda r: (r[1], r[0]))


def batch_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    w = blocks.window()
    df = df.withColumn("rs", F.try_divide("close", "bench"))
    df = blocks.own(blocks.haloed(blocks.numbered(df, order="time"), 20).withColumn("strength", (F.try_divide("rs", s.sma("rs", w, SIZES["long"])) - 1) * 100).withColumn("average", s.sma("strength", w, SIZES["ma"])))
    df = blocks.record_before(df, "strength", "record")
    return {(r["symbol"], r["time"]): (r["strength"], r["average"], r["strength"] is not None and r["strength"] > r["record"]) for r in df.collect()}


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_bars_one_by_one(spark, tmp_path, batches):
    rows = bars()
    rnd = random.Random(batches)
    size = -(-len(rows) // batches)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    source, sink = tmp_path / "in", tmp_path / "out"
    end = [("z", START + timedelta(days=9), 1.0, 1.0, 1.0, 1.0)]
    late = [("a", START, 999.0, 1.0, 500.0, 1.0)]
    for i, part in enumerate([*parts, end, late]):
        rnd.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))  # each query starts anew from the checkpoint
        out = bar_state.strength_stream(stream, "1 hour", **SIZES)
        out.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(sink)).where("symbol <> 'z'").collect()
    assert len(got) == len(rows) == len({(r["symbol"], r["time"]) for r in got})
    for symbol in ("a", "b"):
        own = [r for r in rows if r[0] == symbol]
        line = bar_state.Line(*SIZES.values())
        want = {r[1]: line.push(*r[1:]) for r in sorted(own, key=lambda r: r[1])}
        for r in got:
            if r["symbol"] == symbol:
                assert tuple(r)[1:] == want[r["time"]]


def test_lines_equal_the_batch_indicators(spark):
    rows = bars()
    df = spark.createDataFrame(rows, SCHEMA)
    known = df.select("symbol", "time", "high", "low", "close", F.lit(100).cast("bigint").alias("volume"))
    bench = df.where("symbol = 'a' and bench is not null").select("time", "bench")
    out = indicators.relative_strength(known, bench, SIZES["long"], SIZES["ma"], SIZES["atr"], "time", SIZES["atr_ma"])
    want = {(r["symbol"], r["time"]): r for r in indicators.signals(indicators.screens(out)).collect()}
    high, seen = batch_rows(spark, [(r["symbol"], r["time"], r["high"], r["low"], r["close"], r["bench"]) for r in want.values()]), 0
    for symbol in ("a", "b"):
        line = bar_state.Line(*SIZES.values())
        for r in sorted((r for r in want.values() if r["symbol"] == symbol), key=lambda r: r["time"]):
            _, strength, average, threshold, zone, new_high, crossed, moved, changed = line.push(r["time"], r["high"], r["low"], r["close"], r["bench"])
            for got, c in ((strength, "strength"), (average, "average"), (threshold, "threshold")):
                assert got == (None if r[c] is None else pytest.approx(r[c], rel=1e-9, abs=1e-9)), (symbol, r["time"], c)
            assert (zone, crossed, moved, changed) == (r["zone"], r["crossed"], r["moved_far"], r["zone_changed"])
            assert new_high == high[symbol, r["time"]][2]
            seen += crossed + new_high
    assert seen > 5


TABLE = T.StructType().add("symbol", "string").add("day", "date").add("close", "double").add("volume", "long").add("ord", "integer")


def files(path):
    return {p.parent.name: sorted(q.name for q in p.parent.glob("*.parquet")) for p in Path(path).glob("data/*/*/*.parquet")}


def test_partial_upserts(spark, tmp_path):
    path, source, cp = str(tmp_path / "table"), str(tmp_path / "in"), str(tmp_path / "cp")
    part = F.date_format("day", "yyyy-MM")
    day = lambda m, d: datetime(2024, m, d).date()
    loads = [
        [("a", day(1, 5), 1.0, 10, 0), ("a", day(2, 5), 2.0, 20, 0), ("b", day(2, 6), 3.0, 30, 0), ("c", None, 4.0, 40, 0)],
        [("a", day(2, 5), 2.5, 99, 2), ("a", day(2, 5), 2.4, 98, 1), ("d", day(3, 1), 5.0, 50, 1)],
    ]
    whole = spark.createDataFrame([], TABLE)
    schema = T.StructType([f for f in TABLE.fields if f.name != "volume"])
    for i, rows in enumerate(loads):
        df = spark.createDataFrame(rows, TABLE)
        df = df if i == 0 else df.drop("volume")
        df.coalesce(1).write.parquet(f"{source}{i}")
        before = files(path)
        stream = spark.readStream.schema(TABLE if i == 0 else schema).parquet(f"{source}{i}")
        partial_upserts.start_partial_upserts(stream, path, f"{cp}{i}", TABLE, ["symbol", "day"], "ord", part).awaitTermination() if i == 0 else partial_upserts.merge_batch(path, TABLE, ["symbol", "day"], "ord", part, df, i)
        whole = upsert.merge_columns(whole, df, ["symbol", "day"], "ord") if i else df
        got = partial_upserts.read_table(spark, path, TABLE)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*TABLE.names).collect()))
        if i:
            assert files(path)["__part=2024-01"] == before["__part=2024-01"] and {p.parent.name for p in Path(path).glob("data/batch=1/*/*.parquet")} == {"__part=2024-02", "__part=2024-03"}
    at = {(r["symbol"], r["day"]): r for r in partial_upserts.read_table(spark, path, TABLE).collect()}
    assert at["a", day(2, 5)]["volume"] == 20 and at["a", day(2, 5)]["close"] == 2.5
    now = files(path)
    partial_upserts.merge_batch(path, TABLE, ["symbol", "day"], "ord", part, spark.createDataFrame(loads[1], TABLE), 1)
    assert files(path) == now
    assert partial_upserts.read_table(spark, path, TABLE, version=0).count() == 4
    assert {r["symbol"] for r in partial_upserts.read_table(spark, path, TABLE, parts=["2024-02"]).collect()} == {"a", "b"}
    assert partial_upserts.drop_unread(spark, path) == 1 and len(at) == partial_upserts.read_table(spark, path, TABLE).count()


def test_a_batch_that_was_broken_off_is_written_again(spark, tmp_path):
    path, part = str(tmp_path / "t"), F.date_format("day", "yyyy-MM")
    df = spark.createDataFrame([("a", START.date(), 1.0, 1, 0)], TABLE)
    partial_upserts.merge_batch(path, TABLE, ["symbol", "day"], "ord", part, df, 0)
    (Path(path) / "versions/0/_SUCCESS").unlink()
    assert partial_upserts.newest(spark, path) is None
    partial_upserts.merge_batch(path, TABLE, ["symbol", "day"], "ord", part, df.withColumn("close", F.lit(2.0)), 0)
    assert [r["close"] for r in partial_upserts.read_table(spark, path, TABLE).collect()] == [2.0]

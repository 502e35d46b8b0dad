"""File sources and the streaming merge on small files made here."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from orrery.functions import clean
from orrery.operators import bridges, upsert
from orrery.sources import market
from orrery.streaming import upserts


def test_csv_with_broken_headers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿"SYMBOL \n","OPEN \n"\n"X 50","1,234.5"\n"A","-"\n', encoding="utf-8")
    df = market.read_csv(spark, str(path), multi_line=True)
    assert df.columns == ["SYMBOL", "OPEN"]
    got = clean.first_present(df, {"symbol": ["SYMBOL"], "open": ["OPEN"], "close": ["LTP"]}).withColumn("open", clean.parse_indian(F.col("open"))).collect()
    assert [tuple(r) for r in got] == [("X 50", 1234.5, None), ("A", None, None)]


def test_history(spark, tmp_path):
    (tmp_path / "h.csv").write_text("Date,Open,High,Low,Close\n03-01-2000,1,2,1,2\nbad,1,2,1,2\n04-01-2000,1,2,1,\n")
    assert [r["date"] for r in market.read_history(spark, str(tmp_path / "h.csv")).collect()] == [date(2000, 1, 3)]


def test_exports_with_other_headers(spark, tmp_path):
    a, b = tmp_path / "NSE_AA&B, 1D.csv", tmp_path / "NSE_CC, 1D.csv"
    a.write_text("time,open,high,low,close,Plot,Volume\n2020-01-01T09:15:00+05:30,1,2,1,2,9,5\n")
    b.write_text("time,open,high,low,close,Volume\n2020-01-02T09:15:00+05:30,1,2,1,NaN,7\n2020-01-03T09:15:00+05:30,1,2,1,3,8\n")
    got = {tuple(r) for r in market.read_exports(spark, [str(a), str(b)]).select("symbol", "date", "volume").collect()}
    assert got == {("AA&B", date(2020, 1, 1), 5), ("CC", date(2020, 1, 3), 8)}


def test_chunks(spark):
    got = market.request_chunks(spark, date(2020, 1, 1), date(2023, 1, 1)).orderBy("from").collect()
    assert got[0]["to"] == date(2022, 9, 26)
    assert got[-1]["to"] == date(2023, 1, 1)


def test_stream_of_upserts(spark, tmp_path):
    schema = "k int, ord int, v string"
    source = tmp_path / "in"
    for i, rows in enumerate([[(1, 1, "a"), (2, 2, "b")], [(2, 3, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        upserts.start_upserts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "ord").awaitTermination()
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()} == {1: "a", 2: "c"}
    spark.createDataFrame([(3, 4, "d")], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    upserts.start_upserts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "ord").awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["v1", "v2"]
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out" / "v2")).collect()} == {1: "a", 2: "c", 3: "d"}


def test_index_files(spark, tmp_path):
    """Row 0 is the index, the others its members; a second file of one index goes with its members."""
    for name, rows in (("MW-A (1).csv", "NIFTY A,1\nP,2\nQ,3"), ("MW-A.csv", "NIFTY A,1\nR,2"), ("MW-B.csv", "NIFTY B,5\nP,6"), ("MW-C.csv", "")):
        (tmp_path / name).write_text(f'"SYMBOL \n","OPEN \n"\n{rows}\n', encoding="utf-8")
    files = [(1, str(tmp_path / "MW-B.csv")), (0, str(tmp_path / "MW-A.csv")), (0, str(tmp_path / "MW-A (1).csv")), (0, str(tmp_path / "MW-C.csv"))]
    got = {(r["index_name"], r["SYMBOL"], r["place"]) for r in market.index_files(spark, files).collect()}
    assert got == {("NIFTY A", "NIFTY A", 0), ("NIFTY A", "P", 1), ("NIFTY A", "Q", 2), ("NIFTY B", "NIFTY B", 0), ("NIFTY B", "P", 1)}


def test_many_files_with_their_own_headers_in_one_scan(spark, tmp_path):
    """Headers in any order, one name twice, quoted line breaks and quotes, short and blank lines, a byte order mark; a thousand files are one scan."""
    (tmp_path / "NSE_A&B, 1D.csv").write_text('\ufefftime,open,close,Volume,close\n2020-01-02T09:15:00+05:30,1,2,10,99\n\n2020-01-03,1\n', encoding="utf-8")
    (tmp_path / "NSE_C.csv").write_text('close,note,time\n7,"two\nlines, ""quoted""",2020-01-05\n8,,2020-01-06\n')
    (tmp_path / "NSE_D.csv").write_text("")
    paths = [str(p) for p in sorted(tmp_path.glob("*.csv"))]
    got = {tuple(r) for r in market.read_exports(spark, paths).select("symbol", "date", "close", "volume", "open").collect()}
    assert got == {("A&B", date(2020, 1, 2), 2.0, 10, 1.0), ("C", date(2020, 1, 5), 7.0, None, None), ("C", date(2020, 1, 6), 8.0, None, None)}
    rows = market.read_headed(spark, paths).select("place", market.cell("note").alias("note"), market.cell("time").alias("time")).collect()
    assert sorted((r["place"], r["note"]) for r in rows if r["time"] == "2020-01-05") == [(0, 'two\nlines, "quoted"')]
    assert sorted(r["place"] for r in rows) == [0, 0, 1, 1]
    for i in range(1000):
        (tmp_path / f"NSE_Z{i}.csv").write_text(("time,close\n2020-01-02,%d\n" if i % 2 else "close,time\n%d,2020-01-02\n") % (i + 1))
    out = market.read_exports(spark, [str(p) for p in tmp_path.glob("NSE_Z*.csv")])
    assert out.agg(F.sum("close"), F.count("*")).first()[:] == (500500.0, 1000)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 1


def test_json_append_and_dump(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1, "v": "x"}, {"k": 2}]')
    df = market.read_json(spark, str(tmp_path / "a.json"), "k int, v string")
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, "x"), (2, None)]
    assert [r["v"] for r in clean.with_defaults(df, {"v": "none"}).orderBy("k").collect()] == ["x", "none"]
    for _ in range(2):
        upsert.append(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    upsert.dump_json(df, str(tmp_path / "dump"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "dump")).collect()) == ['{"k":1,"v":"x"}', '{"k":2,"v":null}']


def test_positions_of_another_provider(spark):
    day = date(2020, 1, 1)
    raw = spark.createDataFrame([(day, "Sun", 100.0, 0.98), (day, "Rahu", 350.5, -0.05), (day, "Mercury", 113.9, -0.2), (day, "Moon", 119.0, 13.0)], "date date, planet string, longitude double, speed double")
    got = {r["planet"]: r for r in market.positions(raw).collect()}
    assert (got["Ketu"]["longitude"], got["Ketu"]["sign_name"], got["Ketu"]["retrograde"]) == (170.5, "Virgo", True)
    assert (got["Mercury"]["retrograde"], got["Mercury"]["combust"], got["Sun"]["nakshatra_name"]) == (True, True, "Pushya")
    own = raw.union(spark.createDataFrame([(day, "Ketu", 171.0, 0.05)], raw.schema))
    assert [r["longitude"] for r in market.positions(own).where("planet = 'Ketu'").collect()] == [171.0]
    moon = market.moon_intraday(raw.where("planet = 'Moon'").selectExpr("date", "'09:15' as time_ist", "longitude", "speed")).first()
    assert (moon["sign_name"], moon["gandanta"], moon["nakshatra_pada"]) == ("Cancer", True, 4)


def test_nan_can_stay(spark):
    df = spark.createDataFrame([("NaN",), ("1,2",), ("x",)], "t string")
    got = [r[0] for r in df.select(clean.parse_float(F.col("t"), keep_nan=True)).collect()]
    assert got[0] != got[0] and got[1:] == [12.0, None]
    assert [r[0] for r in df.select(clean.parse_float(F.col("t"))).collect()] == [None, 12.0, None]


def test_single_row(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("B", 3)], "n string, v int")
    assert [tuple(r) for r in bridges.single_row(df, "n", "a", {"a": "A"}).collect()] == [("A", 1)]
    for name in ("b", "c"):
        with pytest.raises(Exception, match="rows for"):
            bridges.single_row(df, "n", name, {"b": "B", "c": "C"}).collect()

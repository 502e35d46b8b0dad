"""Constraints, cascades, policies, declared factors and shapes on small tables."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from orrery.operators import factors, integrity, policies
from orrery.sources import shapes


def orders(spark):
    rows = [(1, 10, "O", 5.0), (2, None, "O", 5.0), (3, 10, "X", 5.0), (4, 10, "O", 1.0), (5, 99, "F", 5.0), (6, 11, None, None), (7, 11, "F", 9.0)]
    return spark.createDataFrame(rows, "k int, c int, s string, p double")


def test_rows_are_judged_and_counted_in_one_pass(spark, tmp_path):
    parent = spark.createDataFrame([(10,), (11,), (11,), (None,)], "id int")
    checks = [integrity.one_of("s", ["O", "F"]), integrity.refers(["c"], parent, ["id"]), integrity.unique(["c"], "k"), integrity.not_null("c"), integrity.holds("price", F.col("p") > 2)]
    got = {r["k"]: r["reason"] for r in integrity.judged(orders(spark), checks).collect()}
    assert got == {1: None, 2: "not_null:c", 3: "one_of:s", 4: "unique:c", 5: "refers:c", 6: None, 7: "unique:c"}
    counts = integrity.load(orders(spark), checks, str(tmp_path / "out"))
    assert counts == {"rows": 7, "accepted": 2, "one_of:s": 1, "refers:c": 1, "unique:c": 2, "not_null:c": 1, "price": 0}
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("accepted", F.col("accepted").cast("boolean"))
    assert sorted(r["k"] for r in back.where("accepted").collect()) == [1, 6] and back.where("not accepted and reason is null").isEmpty()
    assert integrity.load(orders(spark).limit(0), checks, str(tmp_path / "none"))["rows"] == 0


def tables(spark):
    return {
        "n": spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"),
        "c": spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "id int, n int"),
        "o": spark.createDataFrame([(100, 10), (101, 12), (102, 11)], "id int, c int"),
        "s": spark.createDataFrame([(7, 1), (8, 2)], "id int, n int"),
    }


LINKS = [integrity.Link("c", ("n",), "n", ("id",)), integrity.Link("o", ("c",), "c", ("id",)), integrity.Link("s", ("n",), "n", ("id",), "set_null")]


def test_deletes_follow_keys(spark):
    stays, gone = integrity.delete(tables(spark), LINKS, "n", F.col("v") == "a")
    ids = lambda x: {t: sorted(r["id"] for r in df.collect()) for t, df in x.items()}
    assert ids(stays) == {"n": [2], "c": [12, 13], "o": [101], "s": [7, 8]}
    assert ids(gone) == {"n": [1], "c": [10, 11], "o": [100, 102], "s": []}
    assert {r["id"]: r["n"] for r in stays["s"].collect()} == {7: None, 8: 2}
    refuse = [integrity.Link("c", ("n",), "n", ("id",), "refuse")]
    with pytest.raises(ValueError, match="refer"):
        integrity.delete(tables(spark), refuse, "n", F.col("id") == 1)
    with pytest.raises(ValueError, match="circle"):
        integrity.ordered(["n", "c"], [*LINKS[:1], integrity.Link("n", ("id",), "c", ("id",))])


def test_policies(spark):
    t, rules = tables(spark), policies.Policies()
    see = lambda who, name="c": sorted(r["id"] for r in rules.rows(t[name], name, "select", who).collect())
    assert see(1) == []  # nothing is open without a policy
    rules.allow("c", "select", policies.own("n"))
    rules.allow("c", "select", policies.member(t["n"], "id", F.col("v") == "b"))  # the plain table, so no policy asks itself
    rules.allow("o", "select", lambda who: policies.Through(("c",), rules.rows(t["c"], "c", "select", who), ("id",)))
    rules.allow("o", "select", lambda _: F.col("id") == 101, everybody=True)
    assert see(1) == [10, 11] and see(2) == [10, 11, 12, 13] and see(None) == [] and see(5) == []
    assert see(1, "o") == [100, 101, 102] and see(5, "o") == [101] and see(None, "o") == [101]
    assert rules.rows(t["c"], "c", "update", 2).isEmpty()
    assert rules.rows(t["o"], "o", "select", 1).columns == t["o"].columns


def test_factors_can_be_declared(spark):
    known = factors.given()
    assert len(known.declared) == 40
    known.declare("Low Range", "bars", F.col("low") < 2, date="day")
    with pytest.raises(ValueError, match="already"):
        known.declare("Low Range", "bars", F.col("low") < 1)
    day = date(2020, 1, 1)
    sources = {
        "positions": spark.createDataFrame([(day, "Saturn", True), (day, "Mars", False)], "date date, planet string, retrograde boolean"),
        "aspects": spark.createDataFrame([(day, "Mars", "Saturn", "square"), (day, "Sun", "Saturn", "trine")], "date date, planet_1 string, planet_2 string, aspect_type string"),
        "moon": spark.createDataFrame([(day, "09:15", "Ardra", True), (day, "12:30", "Magha", True)], "date date, time_ist string, nakshatra_name string, gandanta boolean"),
        "bars": spark.createDataFrame([(day, 1.0), (day, 1.5)], "day date, low double"),
    }
    out = known.dates(sources)
    assert {r["factor"] for r in out.collect()} == {"Saturn Retrograde", "Mars-Saturn Hard Aspect", "Moon in Ardra", "Moon Gandanta", "Low Range"} and out.count() == 5
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 4  # each source once
    assert known.dates(sources, ["Low Range"]).count() == 1


def test_tables_of_unknown_shape(spark):
    item = lambda i: {"exchange_code": f"s{i}", "short_name": f" c{i} ", "series": ["EQ", "", "BE"][i % 3]}
    want = {f"S{i}": f"C{i}" for i in range(110) if i % 3 < 2}
    lines = "Symbol, ISEC_CODE ,name,Series\n" + "\n".join(f's{i},c{i},"a, ""b""",{["EQ", "", "BE"][i % 3]}' for i in range(110))
    docs = {
        "dict": {"about": {"x": 1}, "deep": {"master": {f"{i:03}": item(i) for i in range(110)}}},
        "list": [item(i) for i in range(110)],
        "csv": {"raw": lines},
        "few": [item(i) for i in range(100)],
        "other": [{"a": i} for i in range(200)],
        "numbers": list(range(300)),
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("bad", "{not json"), ("null", None), ("empty", ""), ("twice", json.dumps([item(1)] * 105 + [item(1) | {"short_name": "last"}]))]
    got = {}
    for r in shapes.codes(shapes.entries(spark.createDataFrame(rows, "id string, text string"), "id", "text")).collect():
        got.setdefault(r["doc"], {})[r["symbol"]] = r["code"]
    assert got == {"dict": want, "list": want, "csv": want, "twice": {"S1": "LAST"}}


def test_entries_do_not_carry_the_names_of_their_document(spark):
    """Each entry is as large as itself, or a document's entries would grow with their square; the names that nested objects have make no table of the outer one."""
    item = lambda i: {"symbol": f"s{i}", "stock_code": f"c{i}"}
    docs = spark.createDataFrame([("wide", json.dumps({f"id{i:04}": item(i) for i in range(2000)}))], "doc string, text string")
    nodes = docs.select("doc", F.lit("$").alias("path"), F.try_parse_json("text").alias("v"))
    values = [r["value"] for r in shapes._children(nodes).collect()]
    assert len(values) == 2000 and max(len(v.metadata) + len(v.value) for v in values) < 200
    groups = {f"g{g:03}": [item(i) for i in range(105)] for g in range(110)}
    nested = spark.createDataFrame([("nested", json.dumps(groups))], "doc string, text string")
    got = shapes.entries(nested, "doc", "text")
    assert got.where("symbol is not null and code is not null").count() == got.count() == 110 * 105

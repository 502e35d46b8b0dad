"""Every query with SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from orrery.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    if name == "k29_reports":  # nested rows: each day's text, factors and every symbol's return, as the flat queries have them
        flat = {(r["date"], i["symbol"], i["daily_return"]) for r in df.collect() for i in r["impacts"]}
        assert flat == {tuple(r) for r in registry.QUERIES["d01_market_daily"](spark, DATA).select("date", "symbol", "daily_return").collect()}
        said = {(r["date"], r["explanation"]) for r in df.collect()}
        assert said == {tuple(r) for r in registry.QUERIES["d21_explanation"](spark, DATA).collect()}
        return
    rel = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)

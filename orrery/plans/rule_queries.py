"""Queries on declared constraints, policies and cascades over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import integrity, policies
from orrery.sources import shapes
from orrery.sources.market import table


def checks(spark: SparkSession, d: str) -> list[integrity.Check]:
    """What an order must be: a known status, a customer in credit, no second order of a customer on a day."""
    solvent = table(spark, d, "customer").where("c_acctbal >= 0")
    return [
        integrity.not_null("o_custkey"),
        integrity.one_of("o_orderstatus", ["O", "F"]),
        integrity.refers(["o_custkey"], solvent, ["c_custkey"]),
        integrity.unique(["o_custkey", "o_orderdate"], "o_orderkey"),
        integrity.holds("price", F.col("o_totalprice") >= 2000),
    ]


def checked(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the reason that it is refused for."""
    return integrity.judged(table(spark, d, "orders"), checks(spark, d)).select("o_orderkey", "reason")


def counts(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def desk(spark: SparkSession, d: str) -> policies.Policies:
    """Principals are nations: they see their own customers, those of region 1 all in the machinery segment too; orders are seen through customers, urgent ones by everybody."""
    nations, customers = table(spark, d, "nation"), table(spark, d, "customer")
    out = policies.Policies()
    out.allow("customer", "select", policies.own("c_nationkey"))
    out.allow("customer", "select", policies.member(nations, "n_nationkey", F.col("n_regionkey") == 1, lambda _: F.col("c_mktsegment") == "MACHINERY"))
    out.allow("orders", "select", lambda who: policies.Through(("o_custkey",), out.rows(customers, "customer", "select", who), ("c_custkey",)))
    out.allow("orders", "select", lambda _: F.col("o_orderpriority") == "1-URGENT", everybody=True)
    return out


def visible(spark: SparkSession, d: str) -> DataFrame:
    """F16: orders that two nations and nobody see."""
    rules, orders = desk(spark, d), table(spark, d, "orders")
    seen = [rules.rows(orders, "orders", "select", who).select(F.lit(who).cast("int").alias("principal"), "o_orderkey") for who in (1, 7, None)]
    return reduce(DataFrame.union, seen)


LINKS = [
    integrity.Link("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    integrity.Link("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    integrity.Link("supplier", ("s_nationkey",), "nation", ("n_nationkey",), "set_null"),
    integrity.Link("orders", ("o_custkey",), "customer", ("c_custkey",)),
    integrity.Link("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    integrity.Link("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",), "set_null"),
]


def cascaded(spark: SparkSession, d: str) -> DataFrame:
    """Rows and sums of keys that stay and go when a nation is deleted."""
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_nationkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    stays, gone = integrity.delete({t: table(spark, d, t) for t in keys}, LINKS, "nation", F.col("n_nationkey") == 7)
    say = lambda name, what, df: df.agg(F.count("*").alias("n"), F.sum(F.col(keys[name]).cast("bigint")).alias("key_sum")).select(F.lit(name).alias("name"), F.lit(what).alias("what"), "n", "key_sum")
    return reduce(DataFrame.union, [say(t, w, x[t]) for t in keys for w, x in (("stays", stays), ("goes", gone))])


def shapes_found(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and codes of a document for each type and day of events, whose entries lie under the events' numbers."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("day"), F.col("event_id").cast("string").alias("id"), "user_id", k.alias("k"))
    entry = F.struct(F.concat(F.lit(" u"), "user_id").alias("symbol"), F.concat(F.lit("k"), "k").alias("stock_code"), F.when(F.col("k") % 3 == 0, "be").otherwise("eq").alias("series"))
    line = F.concat(F.lit('"'), "id", F.lit('":'), F.to_json(entry))
    master = F.array_join(F.collect_list(line), ",")
    docs = e.groupBy("event_type", "day").agg(F.concat(F.lit('{"version":1,"master":{'), master, F.lit("}}")).alias("text"))
    docs = docs.select(F.concat_ws(":", "event_type", "day").alias("doc"), "text")
    return shapes.codes(shapes.entries(docs, "doc", "text", least=20))


QUERIES = {"s17_shapes": shapes_found, "w05_checked_orders": checked, "w05_check_counts": counts, "f16_visible_orders": visible, "w13_after_delete": cascaded}

_judged = """j0 AS (SELECT o.*, CASE WHEN o_custkey IS NULL THEN 'not_null:o_custkey' WHEN o_orderstatus NOT IN ('O', 'F') THEN 'one_of:o_orderstatus'
 WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN 'refers:o_custkey' END AS r FROM orders o),
j1 AS (SELECT *, CASE WHEN r IS NULL AND o_orderdate IS NOT NULL THEN row_number() OVER (PARTITION BY o_custkey, o_orderdate, r IS NULL ORDER BY o_orderkey) END AS k FROM j0),
j AS (SELECT o_orderkey, CASE WHEN r IS NOT NULL THEN r WHEN k > 1 THEN 'unique:o_custkey,o_orderdate' WHEN o_totalprice < 2000 THEN 'price' END AS reason FROM j1)"""
_two = lambda name, key, gone: f"SELECT '{name}' AS name, CASE WHEN {gone} THEN 'goes' ELSE 'stays' END AS what, {key} AS k FROM {name}"
SQL = {
    "s17_shapes": """WITH e AS (SELECT event_type || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS doc, CAST(event_id AS VARCHAR) AS id, 'U' || user_id AS symbol, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
 m AS (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY doc) >= 20) SELECT doc, symbol, arg_max('K' || k, id) AS code FROM m WHERE k % 3 <> 0 GROUP BY 1, 2""",
    "w05_checked_orders": f"WITH {_judged} SELECT * FROM j",
    "w05_check_counts": f"WITH {_judged} SELECT reason, count(*) AS n FROM j GROUP BY 1",
    "f16_visible_orders": """SELECT 1 AS principal, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation p ON p.n_nationkey = 1 WHERE c_nationkey = 1 OR (p.n_regionkey = 1 AND c_mktsegment = 'MACHINERY') OR o_orderpriority = '1-URGENT'
 UNION ALL SELECT 7, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation p ON p.n_nationkey = 7 WHERE c_nationkey = 7 OR (p.n_regionkey = 1 AND c_mktsegment = 'MACHINERY') OR o_orderpriority = '1-URGENT'
 UNION ALL SELECT NULL, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "w13_after_delete": f"""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c)),
 r AS ({_two('region', 'r_regionkey', 'FALSE')} UNION ALL {_two('nation', 'n_nationkey', 'n_nationkey = 7')} UNION ALL {_two('customer', 'c_custkey', 'c_nationkey = 7')}
 UNION ALL SELECT 'supplier', 'stays', CASE WHEN s_nationkey <> 7 THEN s_nationkey END FROM supplier UNION ALL {_two('orders', 'o_orderkey', 'o_orderkey IN (SELECT * FROM o)')} UNION ALL {_two('lineitem', 'l_orderkey', 'l_orderkey IN (SELECT * FROM o)')})
 SELECT t.name, t.what, count(r.name) AS n, CAST(sum(k) AS BIGINT) AS key_sum FROM (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'orders', 'lineitem']) AS name, w.what FROM (VALUES ('stays'), ('goes')) w(what)) t LEFT JOIN r ON r.name = t.name AND r.what = t.what GROUP BY 1, 2""",
}

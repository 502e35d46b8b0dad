"""Queries on lookups, audits, pages, patches and fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import astro, rules
from orrery.operators import bridges, upsert
from orrery.plans import sql
from orrery.plans.sky_queries import positions
from orrery.plans.table_queries import _one, _ver, _versions, t
from orrery.sources import market


def single(spark: SparkSession, d: str) -> DataFrame:
    return bridges.single_row(t(spark, d, "nation"), "n_name", "N3", {"N3": "NATION_3", "N4": "NATION_4"}).select("n_nationkey", "n_name")


def page(spark: SparkSession, d: str) -> DataFrame:
    return bridges.select(t(spark, d, "customer"), ["c_custkey", "c_name"], order="c_custkey", limit=50, offset=30)


def by_name(spark: SparkSession, d: str) -> DataFrame:
    return bridges.by_name(t(spark, d, "nation"), "n_name", descending=True).limit(5).select("n_nationkey", "n_name")


def exists(spark: SparkSession, d: str) -> DataFrame:
    return bridges.exists(t(spark, d, "orders").where("o_orderpriority like '1-%'"))


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return bridges.first_rows(t(spark, d, "events"), "event_id", 7).select("event_id", "event_type")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return bridges.traded_symbols(t(spark, d, "nation"), "n_name").select("n_nationkey", "n_name")


def nonzero(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier").where("s_nationkey % 3 <> 1").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("member"))
    return bridges.nonzero_counts(s, "n_nationkey", t(spark, d, "nation"))


def mapped(spark: SparkSession, d: str) -> DataFrame:
    return bridges.mapped_counts(t(spark, d, "events").select(bridges.vendor_map(F.col("props")).alias("codes")), "codes", "k")


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols, some with both codes, some with one or none; codes are known for two thirds."""
    p = t(spark, d, "part")
    symbol, k = F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.col("p_partkey")
    code = F.concat(F.lit("c"), (k % 50).cast("string"))
    old = F.when(k % 4 == 0, F.create_map(F.lit("nse"), symbol, F.lit("breeze"), code)).when(k % 4 == 1, F.create_map(F.lit("yahoo"), F.lit("y")))
    known = p.where("p_partkey % 3 <> 0").select(F.lower(symbol).alias("symbol"), code.alias("code"))
    return bridges.code_updates(p.select(k, symbol.alias("symbol"), old.alias("codes")), known)


def patched_codes(spark: SparkSession, d: str) -> DataFrame:
    get = lambda c: F.try_element_at("codes", F.lit(c)).alias(c)
    return _updates(spark, d).select("p_partkey", "action", get("nse"), get("breeze"), get("yahoo"))


def patched(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return upsert.patch_rows(old, new.select("k", "ord", "b"), ["k"], "ord")


def migrated(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return upsert.migrated(old, new.withColumnRenamed("a", "amount"), {"k": "k", "ord": "ord", "a": "amount", "b": "b"}, ["k"], "ord", "b")


def first_files(spark: SparkSession, d: str) -> DataFrame:
    """A22 on customers dealt to files, several of which carry one index name in row 0."""
    c = t(spark, d, "customer")
    rows = c.select((F.col("c_custkey") % 3).alias("category"), F.concat(F.lit("f"), (F.col("c_custkey") % 41).cast("string")).alias("file"), F.expr("c_custkey div 123").alias("place"), "c_custkey", F.concat(F.lit(" i"), (F.col("c_custkey") % 5).cast("string")).alias("name"))
    return market.first_files(rows, "name").select("category", "file", "index_name", "place", "c_custkey")


def categories(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the bodies that have positions, and how many."""
    return positions(spark, d).groupBy("planet").agg(F.count("*").alias("n")).withColumn("category", astro.category(F.col("planet")))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans of the circle, and the positions in each."""
    there = positions(spark, d).select(F.explode(F.array(F.struct(F.lit("nakshatra").alias("kind"), F.col("nakshatra_name").alias("name")), F.struct(F.lit("sign").alias("kind"), F.col("sign_name").alias("name")))).alias("p"))
    many = there.groupBy("p.kind", "p.name").agg(F.count("*").alias("n"))
    return astro.spans(spark).join(many, ["kind", "name"], "left").fillna(0, ["n"])


def demo_factors(spark: SparkSession, d: str) -> DataFrame:
    days = t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return days.select("date", rules.demo_factors(F.col("date"), F.lit("N")).alias("f")).select("date", "f.*")


QUERIES = {
    "j12_single_row": single, "o05_page": page, "o06_by_name": by_name, "o07_exists": exists, "o08_first_rows": first_rows, "f15_symbols": symbols, "a14_nonzero_counts": nonzero,
    "a25_mapped_counts": mapped, "a27_code_actions": lambda s, d: bridges.action_counts(_updates(s, d)), "w07_patched_codes": patched_codes, "w07_patched_rows": patched, "w11_migrated": migrated,
    "a22_first_files": first_files, "d29_spans": spans, "d30_categories": categories, "k26_demo_factors": demo_factors,
}

_parts = "SELECT p_partkey, 'P' || p_partkey AS symbol, 'c' || (p_partkey % 50) AS code, p_partkey % 3 <> 0 AS known, p_partkey % 4 = 0 AS has_both, p_partkey % 4 = 1 AS has_one FROM part"
_acts = f"acts AS (SELECT *, CASE WHEN NOT known THEN 'unmapped' WHEN has_both THEN 'same' ELSE 'updated' END AS action FROM ({_parts}))"
_h31 = lambda text: f"abs(list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, CAST(0 AS BIGINT)))"
SQL = {
    "j12_single_row": "SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_3'",
    "o05_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 30",
    "o06_by_name": "SELECT n_nationkey, n_name FROM nation ORDER BY lower(n_name) DESC LIMIT 5",
    "o07_exists": "SELECT count(*) > 0 AS found FROM orders WHERE o_orderpriority LIKE '1-%'",
    "o08_first_rows": "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 7",
    "f15_symbols": "SELECT n_nationkey, n_name FROM nation WHERE regexp_matches(n_name, '^[A-Z][A-Z0-9&\\-]+$')",
    "a14_nonzero_counts": "SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier WHERE s_nationkey % 3 <> 1 GROUP BY 1",
    "a25_mapped_counts": "SELECT count(*) FILTER (props ->> '$.k' <> '') AS mapped, count(*) AS total FROM events",
    "a27_code_actions": f"WITH {_acts} SELECT count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'same') AS same, count(*) FILTER (action = 'unmapped') AS unmapped FROM acts",
    "w07_patched_codes": f"WITH {_acts} SELECT p_partkey, action, CASE WHEN action = 'updated' OR has_both THEN symbol END AS nse, CASE WHEN action = 'updated' OR has_both THEN code END AS breeze, CASE WHEN has_one THEN 'y' END AS yahoo FROM acts",
    "w07_patched_rows": f"{_ver}, n AS {_one('news', 'DESC')} SELECT o.k, o.ord, o.a, CASE WHEN n.k IS NULL THEN o.b ELSE n.b END AS b FROM o LEFT JOIN n ON o.k = n.k",
    "w11_migrated": f"{_ver}, n AS {_one('(SELECT * FROM news WHERE b IS NOT NULL)', '')} SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)",
    "a22_first_files": """WITH r AS (SELECT c_custkey % 3 AS category, 'f' || (c_custkey % 41) AS file, c_custkey // 123 AS place, c_custkey, trim(' i' || (c_custkey % 5)) AS name FROM customer),
 h AS (SELECT category, file, name AS index_name FROM r WHERE place = 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY category, file) = 1)
 SELECT category, file, index_name, place, c_custkey FROM r JOIN h USING (category, file)""",
    "d29_spans": f"""WITH {sql.POS}, p AS (SELECT 'nakshatra' AS kind, nakshatra_name AS name FROM pos UNION ALL SELECT 'sign', sign_name FROM pos), m AS (SELECT kind, name, count(*) AS n FROM p GROUP BY 1, 2),
 s AS (SELECT 'nakshatra' AS kind, i + 1 AS id, {sql.NAKSHATRAS!r}[i + 1] AS name, CAST(NULL AS VARCHAR) AS element, round_even(i * (360 / CAST(27 AS DOUBLE)), 4) AS start_deg, round_even((i + 1) * (360 / CAST(27 AS DOUBLE)), 4) AS end_deg FROM range(27) t(i)
 UNION ALL SELECT 'sign', i + 1, {sql.SIGNS!r}[i + 1], ['Fire', 'Earth', 'Air', 'Water'][i % 4 + 1], i * CAST(30 AS DOUBLE), (i + 1) * CAST(30 AS DOUBLE) FROM range(12) t(i))
 SELECT s.*, coalesce(n, 0) AS n FROM s LEFT JOIN m USING (kind, name)""",
    "d30_categories": f"WITH {sql.POS} SELECT planet, count(*) AS n, CASE WHEN planet IN ('Rahu', 'Ketu') THEN 'node' WHEN planet IN ('Sun', 'Moon', 'Mars', 'Mercury', 'Jupiter', 'Venus', 'Saturn') THEN 'classical' ELSE 'outer' END AS category FROM pos GROUP BY 1",
    "k26_demo_factors": f"""WITH a AS (SELECT date, {_h31("CAST(date AS VARCHAR) || '-N-'")} AS t, {_h31("CAST(date AS VARCHAR) || '-N-f'")} AS s FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)),
 b AS (SELECT date, least(100, greatest(5, t % 70 + 5 + CASE WHEN t % 17 > 12 THEN 20 ELSE 0 END)) AS total, s % 25 AS a, (s >> 4) % 25 AS b, (s >> 8) % 25 AS c, (s >> 12) % 25 AS d FROM a),
 e AS (SELECT *, CASE WHEN a + b + c + d = 0 THEN 1 ELSE a + b + c + d END AS whole FROM b)
 SELECT date, {', '.join(f"CAST(floor(CAST({x} AS DOUBLE) / whole * total + 0.5) AS BIGINT) AS {n}" for x, n in zip('abcd', ('structural', 'momentum', 'volatility', 'deception'), strict=True))} FROM e""",
}

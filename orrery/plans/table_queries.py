"""Queries on dimension tables, text cleaning and write semantics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.rounding import rounded

from orrery.functions import clean, rules
from orrery.operators import bridges, upsert
from orrery.sources import market


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return market.table(spark, d, name)


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with their nation and region."""
    n = t(spark, d, "nation").withColumnRenamed("n_nationkey", "nation").withColumnRenamed("n_regionkey", "region")
    r = t(spark, d, "region").withColumnRenamed("r_regionkey", "region")
    return bridges.resolved(t(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation"), n, r, "nation", "region").select("s_suppkey", "s_name", "n_name", "r_name")


def joined_names(spark: SparkSession, d: str) -> DataFrame:
    return bridges.joined_names(t(spark, d, "nation"), "n_regionkey", "n_name", 40)


def member_counts(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return bridges.member_counts(t(spark, d, "nation").select("n_nationkey", "n_name"), s, "n_nationkey", "s_suppkey")


def breakdown(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").withColumn("segment", F.when(F.col("c_custkey") % 11 == 0, "").when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment")))
    return bridges.breakdown(c, "segment", "c_acctbal").withColumn("weight", rounded("weight", 2))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    names = t(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    return bridges.labelled(t(spark, d, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "name", "Nation").select("c_custkey", "name")


def index_sets(spark: SparkSession, d: str) -> DataFrame:
    out = bridges.index_sets(t(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")
    return out.select("c_nationkey", F.array_join("index_names", "|").alias("index_names"), "first_index")


def containment(spark: SparkSession, d: str) -> DataFrame:
    sets = bridges.index_sets(t(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")
    return bridges.in_all(sets, "index_names", "BUILDING", "MACHINERY").select("c_nationkey")


def json_key(spark: SparkSession, d: str) -> DataFrame:
    codes = t(spark, d, "events").select("event_id", bridges.vendor_map(F.col("props")).alias("m"))
    return codes.select("event_id", F.try_element_at("m", F.lit("k")).alias("k")).where("k is not null and k <> ''")


def vendor_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes by a map, else a fixed table, else the symbol with a suffix."""
    p = t(spark, d, "part")
    codes = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("yahoo"), F.col("p_type"))).when(F.col("p_partkey") % 3 == 1, F.create_map(F.lit("yahoo"), F.lit("")))
    return p.select("p_partkey", bridges.vendor_code(codes, F.col("p_brand"), {"BRAND#11": "B11", "BRAND#12": "B12"}, F.col("p_name")).alias("code"))


def search(spark: SparkSession, d: str) -> DataFrame:
    return bridges.search(t(spark, d, "part"), "Brand#1", "p_name", "p_brand").select("p_partkey", "p_name", "p_brand")


def selected(spark: SparkSession, d: str) -> DataFrame:
    return bridges.select(t(spark, d, "customer"), ["c_custkey", "c_name"], {"c_nationkey": 7}, {"c_mktsegment": "%build%"}, "c_custkey", 20)


def primary(spark: SparkSession, d: str) -> DataFrame:
    return bridges.primary_flags(t(spark, d, "supplier"), "s_nationkey", "s_suppkey").select("s_suppkey", "is_primary")


def exists(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an urgent order, as a semi join."""
    o = t(spark, d, "orders").where("o_orderpriority like '1-%'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


def orphans(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return bridges.orphans(t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("o_custkey")), c, "o_custkey").select("o_orderkey", "o_custkey")


_RAW = "case when o_orderkey % 7 = 0 then '-' when o_orderkey % 7 = 1 then '' when o_orderkey % 7 = 2 then 'NaN' when o_orderkey % 7 = 3 then '0' when o_orderkey % 7 = 4 then concat(' ', cast(o_orderkey as {s}), ',', '123.5 ') when o_orderkey % 7 = 5 then 'n/a' else cast(o_custkey as {s}) end"
_DAY = "case when o_orderkey % 5 = 0 then '31-02-1999' when o_orderkey % 5 = 1 then 'x' else {f} end"


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and dates from messy text."""
    df = t(spark, d, "orders").select("o_orderkey", F.expr(_RAW.format(s="string")).alias("raw"), F.expr(_DAY.format(f="date_format(o_orderdate, 'dd-MM-yyyy')")).alias("day"))
    raw = F.col("raw")
    return df.select("o_orderkey", clean.parse_float(raw).alias("market"), clean.parse_int(raw).alias("whole"), clean.parse_indian(raw).alias("indian"), clean.safe_float(raw, 1).alias("short"), clean.parse_date(F.col("day")).alias("day"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = t(spark, d, "orders")
    cols = lambda x, s: x.select((F.col("o_custkey") % 200).alias("k"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * s).alias("a"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("b"))
    old = upsert.first_wins(cols(o.where("o_orderkey % 2 = 0 and o_custkey % 3 = 0"), 1), ["k"], "ord")
    return old, cols(o.where("o_orderkey % 2 = 1"), 10)


def ignore(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return upsert.insert_or_ignore(old, new, ["k"], "ord", ["b"])


def replace(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return upsert.insert_or_replace(old, new, ["k"], "ord")


def merged(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return upsert.merge_columns(old, new.select("k", "ord", "b"), ["k"], "ord")


def deduped(spark: SparkSession, d: str) -> DataFrame:
    """Of equal names the least id stays."""
    p = t(spark, d, "part")
    return upsert.first_wins(p.select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"], "p_partkey")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """What each symbol's history takes in requests, from its first to its last trade, and the trades of each span."""
    trades = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"))
    spans = market.span_chunks(trades.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b")), "a", "b")
    days = trades.groupBy("symbol", "date").agg(F.count("*").alias("n")).withColumnRenamed("symbol", "s")
    found = spans.join(days, (F.col("symbol") == F.col("s")) & F.col("date").between(F.col("from"), F.col("to")), "left")
    return found.groupBy("symbol", "from", "to").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def vendor_master(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit(" s"), F.col("o_custkey") % 50).alias("exchange_code"), F.when(F.col("o_orderkey") % 4 == 0, "EQ").when(F.col("o_orderkey") % 4 == 1, " ").when(F.col("o_orderkey") % 4 == 2, "BE").alias("series"), F.concat(F.lit("c"), F.col("o_orderkey") % 97).alias("isec_code")
    )
    return market.vendor_codes(rows)


def demo(spark: SparkSession, d: str) -> DataFrame:
    """Seeded demonstration scores."""
    h = rules.string_hash(F.col("p_brand"))
    return t(spark, d, "part").select("p_brand").distinct().select("p_brand", h.alias("seed"), rules.demo_score(h).alias("score"))


def unnested(spark: SparkSession, d: str) -> DataFrame:
    """Arrays unnested, bags joined, distinct rows."""
    words = t(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return words.unionByName(words.where("p_partkey % 2 = 0")).distinct()


QUERIES = {
    "j01_resolved_bridge": resolved, "a11_joined_names": joined_names, "j02_member_counts": member_counts, "a13_breakdown": breakdown, "j10_labelled": labelled, "a21_index_sets": index_sets,
    "f13_containment": containment, "f14_json_key": json_key, "j11_vendor_codes": vendor_codes, "f12_search": search, "s11_select": selected, "n25_primary": primary, "j16_exists": exists, "f02_orphans": orphans,
    "c01_cleaned": cleaned, "w01_insert_or_ignore": ignore, "w02_insert_or_replace": replace, "w04_merge_columns": merged, "w12_keep_least_id": deduped, "s10_request_chunks": chunks, "s17_vendor_master": vendor_master,
    "k26_demo_scores": demo, "u06_unnested": unnested,
}

_raw = _RAW.format(s="varchar").replace("concat(' ', cast(o_orderkey as varchar), ',', '123.5 ')", "' ' || cast(o_orderkey as varchar) || ',' || '123.5 '")
_num = "try_cast(replace(trim(raw), ',', '') AS DOUBLE)"
_fin = f"CASE WHEN NOT isnan({_num}) THEN {_num} END"
_cols = lambda s: f"o_custkey % 200 AS k, o_orderkey AS ord, o_orderkey * {s} AS a, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS b"
_one = lambda src, o: f"(SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord {o}) = 1)"
_ver = f"WITH olds AS (SELECT {_cols(1)} FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 = 0), news AS (SELECT {_cols(10)} FROM orders WHERE o_orderkey % 2 = 1), o AS {_one('olds', '')}"
SQL = {
    "j01_resolved_bridge": "SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "a11_joined_names": "SELECT n_regionkey, names, CASE WHEN length(names) > 40 THEN names[1:40] || '...' ELSE names END AS shown FROM (SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1)",
    "j02_member_counts": "SELECT n_nationkey, n_name, count(s_suppkey) AS members FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1, 2",
    "a13_breakdown": "SELECT coalesce(nullif(CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 <> 0 THEN c_mktsegment END, ''), 'Unknown') AS segment, round_even(sum(coalesce(c_acctbal, 0)), 2) AS weight FROM customer GROUP BY 1",
    "j10_labelled": "SELECT c_custkey, coalesce(n_name, 'Nation #' || c_nationkey) AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey",
    "a21_index_sets": "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS index_names, arg_min(c_mktsegment, c_custkey) AS first_index FROM customer GROUP BY 1",
    "f13_containment": "SELECT c_nationkey FROM customer GROUP BY 1 HAVING bool_or(c_mktsegment = 'BUILDING') AND bool_or(c_mktsegment = 'MACHINERY')",
    "f14_json_key": "SELECT event_id, props ->> '$.k' AS k FROM events WHERE props ->> '$.k' <> ''",
    "j11_vendor_codes": "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN nullif(p_type, '') END, CASE upper(p_brand) WHEN 'BRAND#11' THEN 'B11' WHEN 'BRAND#12' THEN 'B12' END, p_name || '.NS') AS code FROM part",
    "f12_search": "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1')",
    "s11_select": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_mktsegment ILIKE '%build%' ORDER BY c_custkey LIMIT 20",
    "n25_primary": "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1 AS is_primary FROM supplier",
    "j16_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority LIKE '1-%')",
    "f02_orphans": "SELECT o_orderkey, o_custkey * 2 AS o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey * 2)",
    "c01_cleaned": f"SELECT o_orderkey, nullif({_fin}, 0) AS market, CAST(trunc({_fin}) AS BIGINT) AS whole, CASE WHEN trim(raw) NOT IN ('', '-') THEN {_fin} END AS indian, round_even({_fin}, 1) AS short, CAST(try_strptime(day, '%d-%m-%Y') AS DATE) AS day FROM (SELECT o_orderkey, {_raw} AS raw, {_DAY.format(f=chr(39).join(['strftime(o_orderdate, ', '%d-%m-%Y', ')']))} AS day FROM orders)",
    "w01_insert_or_ignore": f"{_ver} SELECT * FROM o UNION ALL SELECT * FROM {_one('(SELECT * FROM news WHERE b IS NOT NULL)', '')} WHERE k NOT IN (SELECT k FROM o)",
    "w02_insert_or_replace": f"{_ver}, n AS {_one('news', 'DESC')} SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n",
    "w04_merge_columns": f"{_ver}, n AS {_one('news', 'DESC')} SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN o.ord ELSE n.ord END AS ord, o.a, CASE WHEN n.k IS NULL THEN o.b ELSE n.b END AS b FROM o FULL JOIN n ON o.k = n.k",
    "w12_keep_least_id": "SELECT p_partkey, p_brand, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1",
    "s10_request_chunks": """WITH l AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem), s AS (SELECT symbol, min(date) AS a, max(date) AS b FROM l GROUP BY 1),
 c AS (SELECT symbol, CAST(unnest(generate_series(a, b, INTERVAL 1000 DAY)) AS DATE) AS f, b FROM s), r AS (SELECT symbol, f, least(f + 999, b) AS z FROM c)
 SELECT r.symbol, f AS "from", z AS "to", count(l.date) AS n FROM r LEFT JOIN l ON l.symbol = r.symbol AND l.date BETWEEN f AND z GROUP BY 1, 2, 3""",
    "s17_vendor_master": "SELECT symbol, arg_max(code, ord) AS code FROM (SELECT o_orderkey AS ord, upper(trim(' s' || (o_custkey % 50))) AS symbol, upper('c' || (o_orderkey % 97)) AS code FROM orders WHERE o_orderkey % 4 IN (0, 1, 3)) GROUP BY 1",
    "k26_demo_scores": "SELECT p_brand, seed, least(100, greatest(5, seed % 70 + 5 + CASE WHEN seed % 17 > 12 THEN 20 ELSE 0 END)) AS score FROM (SELECT p_brand, abs(list_reduce(list_transform(string_split(p_brand, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, CAST(0 AS BIGINT))) AS seed FROM (SELECT DISTINCT p_brand FROM part))",
    "u06_unnested": "SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
}

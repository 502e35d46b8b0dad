"""Dimension and bridge tables: lookups, compositions, set columns, vendor codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved(bridge: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """A bridge with both ends resolved; unmatched rows go."""
    return bridge.join(left, left_key).join(right, right_key)


def labelled(bridge: DataFrame, names: DataFrame, key: str, name: str, prefix: str) -> DataFrame:
    """Left lookup with the label '<prefix> #<id>' where there is none."""
    return bridge.join(names, key, "left").withColumn(name, F.coalesce(F.col(name), F.concat(F.lit(f"{prefix} #"), F.col(key).cast("string"))))


def joined_names(df: DataFrame, key: str, name: str, most: int = 80) -> DataFrame:
    """Names of each key in order, cut to `most` characters and marked."""
    df = df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("names"))
    return df.withColumn("shown", F.when(F.length("names") > most, F.concat(F.substring("names", 1, most), F.lit("..."))).otherwise(F.col("names")))


def member_counts(parents: DataFrame, members: DataFrame, key: str, member: str) -> DataFrame:
    """Every parent with its number of members, 0 too."""
    return parents.join(members, key, "left").groupBy(*parents.columns).agg(F.count(member).alias("members"))


def breakdown(df: DataFrame, label: str, weight: str) -> DataFrame:
    """Weights by label, null and '' as Unknown, missing weights 0."""
    return df.groupBy(F.coalesce(F.nullif(label, F.lit("")), F.lit("Unknown")).alias(label)).agg(F.sum(F.coalesce(F.col(weight), F.lit(0.0))).alias("weight"))


def index_sets(members: DataFrame, symbol: str, index: str, order: str) -> DataFrame:
    """Each symbol's sorted set of indices, and its first row's index."""
    return members.groupBy(symbol).agg(F.sort_array(F.collect_set(index)).alias("index_names"), F.min_by(index, order).alias("first_index"))


def in_all(df: DataFrame, column: str, *values: str) -> DataFrame:
    """Rows whose array holds all values."""
    return df.where(F.forall(F.array(*map(F.lit, values)), lambda v: F.array_contains(F.col(column), v)))


def vendor_map(text: Column) -> Column:
    """Map of a JSON object, also of one that is a JSON string."""
    inner = F.when(text.startswith('"'), F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "struct<x:string>")["x"]).otherwise(text)
    return F.from_json(inner, "map<string,string>")


def merged_maps(old: Column, new: Column) -> Column:
    """Right wins."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def vendor_code(codes: Column, name: Column, known: dict[str, str], symbol: Column, vendor: str = "yahoo") -> Column:
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.coalesce(F.nullif(F.try_element_at(codes, F.lit(vendor)), F.lit("")), F.try_element_at(F.create_map(*pairs), F.upper(name)), F.concat(symbol, F.lit(".NS")))


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Case-insensitive part of any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    return df.where(hit)


def select(df: DataFrame, columns: list[str], equal: dict | None = None, ilike: dict | None = None, order: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Projection, equality, ILIKE, order, offset and limit."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    for c, p in (ilike or {}).items():
        df = df.where(F.col(c).ilike(p))
    df = df.orderBy(order) if order else df
    df = df.offset(offset) if offset else df
    return (df.limit(limit) if limit else df).select(*columns)


def primary_flags(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key is primary."""
    return df.withColumn("is_primary", F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that a foreign key would refuse."""
    return child.join(parent.select(key), key, "left_anti")


def nonzero_counts(df: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """(key, n) of the parents that have rows, the most first, equal ones by key."""
    return parents.select(key).join(df, key, "left").groupBy(key).agg(F.count(F.col("member")).alias("n")).where("n > 0").orderBy(F.desc("n"), key)


def single_row(df: DataFrame, column: str, name: str, names: dict[str, str]) -> DataFrame:
    """The one row whose column is what `names` gives for `name`; an error, when it is read, if there is none or more than one."""
    if name not in names:
        raise KeyError(name)
    rows = df.where(F.col(column) == names[name]).limit(2)
    found = rows.agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("row"))
    problem = F.raise_error(F.concat(F.lit(f"rows for {names[name]}: "), F.col("n").cast("string")))
    return found.select(F.when(F.col("n") == 1, F.col("row")).otherwise(problem.cast(df.schema)).alias("row")).select("row.*")


def exists(df: DataFrame) -> DataFrame:
    """One row (found), true if the table has any row; one row is read."""
    return df.limit(1).agg((F.count("*") > 0).alias("found"))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by a column."""
    return df.orderBy(order).limit(n)


def by_name(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows in the order of a text column whatever its case and accents, either way; equal ones by the text itself."""
    keys = [F.collate(F.col(column), "UNICODE_CI_AI"), F.col(column)]
    return df.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def traded_symbols(df: DataFrame, column: str) -> DataFrame:
    """rows whose text is a symbol, capital letters and digits with & or - after the first."""
    return df.where(F.col(column).rlike(r"^[A-Z][A-Z0-9&\-]+$"))


def mapped_counts(df: DataFrame, codes: str, vendor: str) -> DataFrame:
    """How many rows have a vendor's code, and how many there are."""
    return df.agg(F.sum(has_code(F.col(codes), vendor).cast("bigint")).alias("mapped"), F.count("*").alias("total"))


def has_code(codes: Column, vendor: str) -> Column:
    return F.coalesce(F.try_element_at(codes, F.lit(vendor)) != "", F.lit(False))


def code_updates(symbols: DataFrame, known: DataFrame, codes: str = "codes") -> DataFrame:
    """symbols with the action (updated, same or unmapped) and the codes after it: a known code and the symbol itself are put into the map (A27, W07). known: (symbol, code)."""
    both = symbols.join(known.select(F.upper("symbol").alias("key"), "code"), F.upper(F.col("symbol")) == F.col("key"), "left").drop("key")
    old = F.coalesce(F.col(codes), F.from_json(F.lit("{}"), "map<string,string>"))
    same = F.coalesce((F.try_element_at(old, F.lit("breeze")) == F.col("code")) & (F.try_element_at(old, F.lit("nse")) == F.col("symbol")), F.lit(False))
    action = F.when(F.col("code").isNull() | (F.col("code") == ""), "unmapped").when(same, "same").otherwise("updated")
    new = merged_maps(old, F.create_map(F.lit("nse"), F.col("symbol"), F.lit("breeze"), F.col("code")))
    return both.withColumn("action", action).withColumn(codes, F.when(F.col("action") == "updated", new).otherwise(F.col(codes))).drop("code")


def action_counts(updates: DataFrame) -> DataFrame:
    """One row with the number of each action."""
    return updates.agg(*[F.coalesce(F.sum((F.col("action") == a).cast("bigint")), F.lit(0)).alias(a) for a in ("updated", "same", "unmapped")])

"""Master data of unknown shape: tables of entries found anywhere in JSON documents and flattened."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.cuts import cut

# The names under which a vendor's files may hold a symbol and its code.
SYMBOL_KEYS = ["exchange_code", "exchangecode", "symbol", "nse_code"]
CODE_KEYS = ["short_name", "shortname", "isec_code", "stock_code"]


def cells(line: Column) -> Column:
    """The cells of a CSV line, without their quotes."""
    found = F.regexp_extract_all(F.regexp_replace(line, "\r$", ""), F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), 1)
    return F.transform(found, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), '""', '"')).otherwise(c))


def _children(nodes: DataFrame) -> DataFrame:
    """(doc, path, pos, key, value) of each entry of an object or list; objects' entries come in the order of their keys.

    Each value is a variant of its own: those of variant_explode would all hold
    the names of their whole document, the square of its entries in all.
    """
    fields = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
    items = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    each = nodes.select("doc", "path", F.posexplode(F.coalesce(fields, items)).alias("pos", "item"))
    return each.select("doc", "path", "pos", "item.key", "item.value")


def _kind(value: Column) -> Column:
    """The first character of the value's JSON: { of an object, [ of a list, a quote of a string."""
    return F.substring(F.to_json(value), 1, 1)


def _record(value: Column) -> Column:
    """The fields of an entry that count, as strings."""
    return F.try_variant_get(value, "$", f"struct<{', '.join(f'{k}: string' for k in [*SYMBOL_KEYS, *CODE_KEYS, 'series'])}>")


def _first(record: str, keys: list[str]) -> Column:
    """The first of the keys whose value is not empty."""
    return F.coalesce(*[F.nullif(F.col(f"{record}.{k}"), F.lit("")) for k in keys])


def _has(value: Column, keys: list[str]) -> Column:
    """Whether an object has one of the keys itself, in any case; the keys of what it holds do not count."""
    own = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.arrays_overlap(F.transform(own, F.lower), F.array(*map(F.lit, keys))), F.lit(False))


def entries(docs: DataFrame, doc: str, text: str, least: int = 101, depth: int = 3, least_lines: int = 51) -> DataFrame:
    """(doc, path, pos, symbol, code, series) of every entry of every table found in documents (doc, JSON text).

    A table is an object or list of at least `least` objects, the first of
    which has a symbol and a code under one of their names, or a string of at
    least `least_lines` lines of CSV whose header has both; it may lie `depth` levels deep.
    Text that is not JSON holds none. CSV cells may be quoted, not hold line
    breaks. The first entry tells the shape, as with files of one writer;
    entries that lack a name have nulls.
    """
    docs = cut(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), "documents")  # two branches read it
    nodes = docs.select("doc", F.lit("$").alias("path"), F.try_parse_json("text").alias("v")).withColumn("kind", _kind(F.col("v")))
    found, lines = [], []
    for level in range(depth + 1):
        lines.append(nodes.where("kind = '\"'").select("doc", "path", F.try_variant_get("v", "$", "string").alias("csv")))
        if level == depth:
            break
        each = _children(nodes)
        shape = F.when(F.col("pos") == 0, _has(F.col("value"), SYMBOL_KEYS) & _has(F.col("value"), CODE_KEYS))
        each = cut(each.withColumns({"is_table": shape, "kind": _kind(F.col("value")), "r": _record(F.col("value"))}), "entries")  # four branches read it
        sizes = each.groupBy("doc", "path").agg(F.count("*").alias("n"), F.max("is_table").alias("is_table"))
        tables = sizes.where((F.col("n") >= least) & F.col("is_table")).select("doc", "path")
        rows = each.join(tables, ["doc", "path"], "left_semi")
        found.append(rows.select("doc", "path", "pos", _first("r", SYMBOL_KEYS).alias("symbol"), _first("r", CODE_KEYS).alias("code"), F.col("r.series").alias("series")))
        step = F.concat("path", F.coalesce(F.concat(F.lit("."), F.col("key")), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))
        deeper = each.where(F.col("kind").isin("{", "[", '"')).join(tables, ["doc", "path"], "left_anti")
        nodes = deeper.select("doc", step.alias("path"), F.col("value").alias("v"), "kind")
    text_ = reduce(DataFrame.union, lines)
    text_ = text_.select("doc", "path", F.split(F.trim("csv"), "\n").alias("lines")).where(F.size("lines") >= least_lines)
    text_ = text_.withColumn("head", F.transform(cells(F.col("lines")[0]), lambda c: F.lower(F.trim(c))))
    text_ = text_.where(F.arrays_overlap("head", F.array(*map(F.lit, SYMBOL_KEYS))) & F.arrays_overlap("head", F.array(*map(F.lit, CODE_KEYS))))
    text_ = text_.select("doc", "path", "head", F.posexplode("lines").alias("pos", "line")).where("pos > 0").withColumn("cells", cells(F.col("line")))
    cell = lambda k: F.nullif(F.try_element_at("cells", F.nullif(F.array_position("head", k), F.lit(0)).cast("int")), F.lit(""))
    found.append(text_.select("doc", "path", F.col("pos") - 1, F.coalesce(*map(cell, SYMBOL_KEYS)).alias("symbol"), F.coalesce(*map(cell, CODE_KEYS)).alias("code"), cell("series").alias("series")))
    return reduce(DataFrame.union, found)


def codes(rows: DataFrame) -> DataFrame:
    """(doc, symbol, code): entries without a series or of series EQ, trimmed and in upper case, of each document's first table that has any; of one symbol the last entry counts."""
    clean = rows.withColumns({c: F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in ("symbol", "code", "series")})
    clean = cut(clean.where("series in ('', 'EQ') and symbol <> '' and code <> ''"), "codes")  # two branches read it
    first = clean.groupBy("doc").agg(F.min("path").alias("path"))
    return clean.join(first, ["doc", "path"], "left_semi").groupBy("doc", "symbol").agg(F.max_by("code", "pos").alias("code"))

"""Daily bars, calendars, the sky model and file sources."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.rounding import rounded
from pyspark.sql import types as T

from orrery.functions import astro, clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_bars(trades: DataFrame) -> DataFrame:
    """symbol, date, open, high, low, close, volume from line items, one trade each: price is the extended price of one piece."""
    t = trades.select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("p"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"),
        "l_quantity",
    )
    return t.groupBy("symbol", "date").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("l_quantity").cast("bigint").alias("volume")
    )


def event_bars(events: DataFrame) -> DataFrame:
    """Daily bars of event values by type, for intraday data."""
    e = events.select("event_type", F.col("ts").cast("date").alias("date"), "value", F.struct("ts", "event_id").alias("k"))
    return e.groupBy("event_type", "date").agg(F.min_by("value", "k").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "k").alias("close"), F.count("*").alias("n"))


def intraday_bars(events: DataFrame, minutes: int) -> DataFrame:
    """Bars (symbol, time, open, high, low, close, volume) of so many minutes of event values by type; time is the interval's start."""
    e = events.select(F.col("event_type").alias("symbol"), F.window("ts", f"{minutes} minutes")["start"].alias("time"), "value", F.struct("ts", "event_id").alias("k"))
    return e.groupBy("symbol", "time").agg(F.min_by("value", "k").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "k").alias("close"), F.count("*").alias("volume"))


def calendar(bars: DataFrame) -> DataFrame:
    """Each day from the first to the last bar."""
    return bars.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))


def positions(raw: DataFrame) -> DataFrame:
    """Sign, nakshatra, pada, direction and combustion of any provider's (date, planet, longitude, speed).

    Ketu, where the provider has none on a date, is put opposite to Rahu.
    Longitudes are sidereal, in degrees from 0 to 360; places are judged before they are rounded to six digits.
    """
    raw = raw.select("date", "planet", F.col("longitude").alias("lon"), rounded("speed", 6).alias("speed")).withColumn("longitude", rounded("lon", 6))
    there = raw.where("planet = 'Ketu'").select("date")
    ketu = raw.where("planet = 'Rahu'").join(there, "date", "left_anti")
    ketu = ketu.select("date", F.lit("Ketu").alias("planet"), F.expr("longitude + 180 - 360 * floor((longitude + 180) / 360)").alias("lon"), (-F.col("speed")).alias("speed"))
    ketu = ketu.select("date", "planet", "lon", "speed", rounded("lon", 6).alias("longitude"))
    sun = raw.where("planet = 'Sun'").select("date", F.col("longitude").alias("sun"))
    out = raw.unionByName(ketu).join(sun, "date", "left")
    lon = F.col("lon")
    return out.select(
        "date", "planet", "longitude", "speed",
        (F.col("speed") < 0).__or__(F.col("planet") == "Ketu").alias("retrograde"),
        astro.sign(lon).alias("sign"), astro.sign_name(lon).alias("sign_name"),
        astro.nakshatra(lon).alias("nakshatra"), astro.nakshatra_name(lon).alias("nakshatra_name"), astro.pada(lon).alias("nakshatra_pada"),
        astro.combust(F.col("planet"), F.col("longitude"), F.col("sun")).alias("combust"),
    )


def moon_intraday(raw: DataFrame) -> DataFrame:
    """Places of any provider's (date, time_ist, longitude, speed) of the Moon."""
    lon = F.col("longitude")
    return raw.select(
        "date", "time_ist", rounded("longitude", 6).alias("longitude"), "speed", astro.sign(lon).alias("sign"), astro.sign_name(lon).alias("sign_name"),
        astro.nakshatra(lon).alias("nakshatra"), astro.nakshatra_name(lon).alias("nakshatra_name"), astro.pada(lon).alias("nakshatra_pada"), astro.gandanta(lon).alias("gandanta"),
    )


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns text, headers stripped, a byte order mark dropped."""
    df = spark.read.option("header", True).option("multiLine", multi_line).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


#: Cells of a line that read_headed() looks at.
CELLS = 128


def read_headed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, place, head, cells) of every data line of many CSV files, whose headers may differ, in one scan.

    place counts a file's data lines from 0; head holds its header's names,
    without spaces, line breaks or a byte order mark, and cells the line's
    texts, in the same order; cell() picks one by name. Cells may hold quoted
    line breaks. A short line's last cells are null; cells beyond CELLS are
    not read, blank lines neither. A file is one task's, since only its start says what it
    holds; a file of no lines gives none.
    """
    schema = ", ".join(f"c{i} string" for i in range(CELLS))
    raw = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(paths)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.array(*[f"c{i}" for i in range(CELLS)]).alias("cells"))
    raw = raw.where(F.exists("cells", lambda c: c.isNotNull()))
    w = Window.partitionBy("file").orderBy("id")
    rows = raw.select("file", "cells", F.first("cells").over(w).alias("head"), (F.row_number().over(w) - 2).alias("place")).where("place >= 0")
    name = lambda c: F.trim(F.regexp_replace(c, "^\ufeff|[\r\n]", ""))
    return rows.select("file", "place", F.transform("head", name).alias("head"), "cells")


def cell(name: str, ignore_case: bool = False) -> Column:
    """The cell of read_headed() rows under a name; the first of equal names; null where the file lacks it."""
    head = F.transform("head", F.lower) if ignore_case else F.col("head")
    return F.try_element_at("cells", F.nullif(F.array_position(head, name.lower() if ignore_case else name), F.lit(0)).cast("int"))


def index_files(spark: SparkSession, files: list[tuple[int, str]], name: str = "SYMBOL", columns: list[str] | None = None) -> DataFrame:
    """Rows of index files with category, file, place (0 is the index itself, the others its members) and index_name.

    files: (rank of the category, path). All are read in one scan; `columns`
    are those wanted, by default every name of any header, which takes a look
    at the files before. Of files with one index name the first by category,
    then by file name, stays; the others go with their members.
    """
    if not files:
        raise ValueError("no files")
    rows = read_headed(spark, [path for _, path in files])
    if columns is None:
        columns = sorted(r[0] for r in rows.where("place = 0").select(F.explode("head").alias("n")).where("n <> ''").distinct().collect())
    ranks = spark.createDataFrame([(path.rsplit("/", 1)[-1], int(rank)) for rank, path in files], "file string, category int").groupBy("file").agg(F.min("category").alias("category"))
    rows = rows.withColumn("file", F.url_decode(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\+", "%2B")))
    rows = rows.join(ranks, "file").select(*[cell(c).alias(c) for c in dict.fromkeys([*columns, name])], "place", "category", "file")
    return first_files(rows, name)


def first_files(rows: DataFrame, name: str) -> DataFrame:
    """A22 on rows with category, file and place: index_name is the name in each file's row 0; of equal ones the first file's rows stay."""
    own = Window.partitionBy("category", "file")
    rows = rows.withColumn("index_name", F.max(F.when(F.col("place") == 0, F.trim(F.col(name)))).over(own))
    heads = rows.where("place = 0 and index_name <> ''").groupBy("index_name").agg(F.min(F.struct("category", "file")).alias("first"))
    return rows.join(heads.select("index_name", "first.category", "first.file"), ["index_name", "category", "file"], "left_semi")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Dates dd-MM-yyyy; rows without a date or close go."""
    df = clean.normalized_columns(read_csv(spark, path), {"price": "date"})
    clean.require_columns(df, "date", "open", "high", "low", "close")
    cols = {c: clean.parse_float(F.col(c)) for c in ("open", "high", "low", "close")}
    return df.withColumns(cols).withColumn("date", clean.parse_date(F.col("date"))).where("date is not null and close is not null")


def read_exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Bars of all files in one scan, though their headers differ; the symbol is in the file's name."""
    if not paths:
        raise ValueError("no files")
    at = lambda c: cell(c, ignore_case=True)
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\+", "%2B"))
    out = read_headed(spark, paths).select(
        F.regexp_extract(name, "NSE_([A-Z0-9&]+)", 1).alias("symbol"),
        clean.prefix_date(at("time")).alias("date"),
        *[clean.parse_float(at(c)).alias(c) for c in ("open", "high", "low", "close")],
        clean.parse_int(at("volume")).alias("volume"),
    )
    return out.where("date is not null and close is not null")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An array of objects in each file."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def request_chunks(spark: SparkSession, start: date, end: date, days: int = 1000) -> DataFrame:
    """The spans of at most `days` days that a vendor is asked for."""
    return span_chunks(spark.createDataFrame([(start, end)], "a date, b date"), "a", "b", days)


def span_chunks(rows: DataFrame, start: str, end: str, days: int = 1000) -> DataFrame:
    """S10 for each row: its span of dates cut into pieces (from, to) of at most `days` days; other columns stay."""
    starts = rows.withColumn("from", F.explode(F.expr(f"sequence(`{start}`, `{end}`, interval {days} days)")))
    return starts.withColumn("to", F.least(F.date_add("from", days - 1), F.col(end))).drop(start, end)


def vendor_codes(rows: DataFrame) -> DataFrame:
    """(symbol, code) from vendor master rows (ord, exchange_code, series, isec_code): blank or EQ series, upper case, the last one wins."""
    r = rows.withColumns({"symbol": F.upper(F.trim("exchange_code")), "code": F.upper(F.trim("isec_code")), "s": F.upper(F.trim(F.coalesce("series", F.lit(""))))})
    r = r.where("s in ('', 'EQ') and symbol <> '' and code <> ''")
    return r.groupBy("symbol").agg(F.max_by("code", "ord").alias("code"))

"""Write semantics as table operators (W01 to W12, W05, W07, W08 and W11 among them): no keys are enforced by files, so they are here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Sequence[str], order: Column | str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def last_wins(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    return first_wins(df, key, F.desc(order))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Sequence[str], order: str, not_null: Sequence[str] = ()) -> DataFrame:
    """Existing rows stay; of new rows the first of a key; rows with a null where none may be are skipped."""
    for c in not_null:
        new = new.where(F.col(c).isNotNull())
    fresh = first_wins(new, key, order).join(old.select(*key), list(key), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def insert_or_replace(old: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    fresh = last_wins(new, key, order)
    return old.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh.select(*old.columns))


def merge_columns(old: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Supplied columns overwrite, with nulls too; columns that `new` lacks keep their old values."""
    fresh = last_wins(new, key, order).withColumn("__new", F.lit(True))
    supplied = [c for c in old.columns if c in new.columns and c not in key]
    renamed = fresh.select(*key, "__new", *[F.col(c).alias(f"__{c}") for c in supplied])
    both = old.join(renamed, list(key), "full")
    return both.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c) for c in old.columns])


def patch_rows(old: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Columns of `new` overwrite those of existing rows of the key, the last one wins; keys that `old` lacks are ignored."""
    supplied = [c for c in new.columns if c not in key and c != order and c in old.columns]
    fresh = last_wins(new, key, order).select(*key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in supplied])
    both = old.join(fresh, list(key), "left")
    return both.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c) for c in old.columns])


def migrated(old: DataFrame, source: DataFrame, names: dict[str, str], key: Sequence[str], order: str, not_null: str) -> DataFrame:
    """Rows of `source` that have `not_null`, under new names, inserted where the key is free. names: column of old to column of source."""
    rows = source.where(F.col(not_null).isNotNull()).select(F.col(order).alias("__order"), *[F.col(s).alias(t) for t, s in names.items()])
    fresh = first_wins(rows, key, "__order").join(old.select(*key), list(key), "left_anti")
    return old.unionByName(fresh.drop("__order"), allowMissingColumns=True)


def append(df: DataFrame, path: str) -> None:
    """Rows are added to a Parquet table; the writer deals them to files, none shows before all are written."""
    df.write.mode("append").parquet(path)


def dump_json(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, one a line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)

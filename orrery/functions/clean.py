"""Typed parsing of text columns (C01 to C11). Bad values become null, never an error."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.rounding import rounded


def parse_float(c: Column, zero_is_null: bool = True, keep_nan: bool = False) -> Column:
    """Trimmed, without commas; '' and text are null, and so are 0 and NaN unless told otherwise."""
    x = F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    x = x if keep_nan else F.when(~F.isnan(x), x)
    return F.nullif(x, F.lit(0.0)) if zero_is_null else x


def parse_int(c: Column) -> Column:
    """Through a double, cut off towards zero; 0 stays."""
    return parse_float(c, zero_is_null=False).try_cast("bigint")


def parse_indian(c: Column) -> Column:
    """Digit groups of two and three; '' and '-' are null, 0 stays."""
    t = F.trim(c)
    return F.when(~t.isin("", "-"), parse_float(t, zero_is_null=False))


def safe_float(c: Column, digits: int = 2) -> Column:
    return rounded(parse_float(c, zero_is_null=False), digits)


def parse_date(c: Column, pattern: str = "dd-MM-yyyy") -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("date")


def prefix_date(c: Column) -> Column:
    """Date of an ISO time: its first ten characters."""
    return F.substring(c, 1, 10).try_cast("date")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def normalized_columns(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Lower case, spaces to underscores, then the given renames."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*[(renames or {}).get(n, n) for n in names])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, variants: Mapping[str, list[str]]) -> DataFrame:
    """A column for each canonical name, from the first header variant that is there, else null."""
    pick = lambda names: next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast("string"))
    return df.select(*[pick(names).alias(c) for c, names in variants.items()])


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})

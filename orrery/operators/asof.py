"""As-of join: each row beside the last row of another table that was known at its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.blocks import time_block


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    values: list[str],
    by: list[str] | None = None,
    tolerance: Column | None = None,
    block: Column | None = None,
    salts: int = 1,
    known_at: str | None = None,
) -> DataFrame:
    """left with `values` of the right row of the same `by` whose `on` is the latest that is not later; every left row stays once.

    Both sides are dealt by key and time block (`block`, of the column `on`)
    and merged in order, so a key's whole history meets nowhere; of each block
    only its last right row goes on to the blocks after it. A right row at the
    same time is known. Of right rows with equal key and time the one with the
    greatest values counts. Right rows whose first value or time is null are
    not known; left rows with a null time or key get nulls. With `tolerance`, values older
    than that (an interval, or a number where `on` is one) are not known.
    known_at names a column for the time of the right row. `salts` spreads the
    left rows of a key and block over so many tasks, each with its own copy of
    the right rows: for one right series that many left rows share.
    """
    by = by or []
    keys = [F.col(f"`{c}`") for c in by]
    whole = F.lit(True)
    for k in keys:
        whole = whole & k.isNotNull()
    part = block if block is not None else time_block(left, on)
    known = right.where(whole & F.col(on).isNotNull() & F.col(values[0]).isNotNull())
    known = known.groupBy(*by, on).agg(F.max(F.struct(*values)).alias("v"))
    known = known.select(*[F.col(f"`{c}`").alias(f"__k{j}") for j, c in enumerate(by)], part.alias("__b"), F.col(on).alias("__t"), F.struct(F.col(on).alias("at"), "v").alias("__known"))
    names = [f"__k{j}" for j in range(len(by))]
    # what is known at a block's start: the last right row of any block before
    last = known.groupBy(*names, "__b").agg(F.max_by("__known", "__t").alias("__past"))
    rows = left.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], part.alias("__b"), F.col(on).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0))
    kind = known.schema["__known"].dataType
    both = rows.withColumn("__known", F.lit(None).cast(kind)).unionByName(known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), allowMissingColumns=True)
    is_left = F.col("__row").isNotNull()  # right rows come first at equal times
    w = Window.partitionBy(*names, "__b", "__salt").orderBy("__t", is_left).rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("__here", F.last("__known", ignorenulls=True).over(w)).where(is_left)
    # the same once more with one row a block: blocks that ask see the last right row of the blocks before
    ask = rows.select(*names, "__b").distinct().withColumns({"__past": F.lit(None).cast(kind), "__asks": F.lit(True)})
    tell = last.withColumn("__asks", F.lit(False))
    order = Window.partitionBy(*names).orderBy("__b", F.desc("__asks")).rowsBetween(Window.unboundedPreceding, 0)
    past = ask.unionByName(tell).withColumn("__past", F.last("__past", ignorenulls=True).over(order)).where("__asks")
    past = past.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("__b").alias("__at"), "__past")
    same = F.col("__b") == F.col("__at")
    for n in names:
        same = same & (F.col(n) == F.col(f"{n}_"))
    found = merged.join(past, same, "left").withColumn("__known", F.coalesce("__here", "__past"))
    if tolerance is not None:
        found = found.withColumn("__known", F.when(F.col("__known.at") >= F.col("__t") - tolerance, F.col("__known")))
    more = [F.col(f"__known.v.{c}").alias(c) for c in values] + ([F.col("__known.at").alias(known_at)] if known_at else [])
    return found.select("__row.*", *more)

"""Declared constraints: rows judged with a reason and counted while they are written; deletes that follow foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """One constraint: its name is the reason that a row is refused for."""

    name: str
    kind: str
    columns: tuple[str, ...]
    holds: Column | None = None
    order: str | None = None
    parent: DataFrame | None = None
    parent_columns: tuple[str, ...] = ()


def not_null(column: str) -> Check:
    return Check(f"not_null:{column}", "row", (column,), F.col(column).isNotNull())


def one_of(column: str, values: Sequence) -> Check:
    """An enumeration; a null is not judged, as in a database."""
    return Check(f"one_of:{column}", "row", (column,), F.coalesce(F.col(column).isin(*values), F.lit(True)))


def holds(name: str, condition: Column) -> Check:
    """A condition; where it is null the row passes."""
    return Check(name, "row", (), F.coalesce(condition, F.lit(True)))


def unique(columns: Sequence[str], order: str) -> Check:
    """Of rows with equal columns the first by `order` stays, which must tell them apart; keys with a null are not judged."""
    return Check(f"unique:{','.join(columns)}", "unique", tuple(columns), order=order)


def refers(columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> Check:
    """A foreign key; keys with a null are not judged."""
    return Check(f"refers:{','.join(columns)}", "refers", tuple(columns), parent=parent, parent_columns=tuple(parent_columns))


def judged(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """df with `reason`: the first check, as they are listed, that a row fails, null for an accepted row.

    A unique check judges the rows that pass the checks before it, so a refused
    row takes no key from another. The first of a key is found by a minimum,
    which is taken in each task first, so a frequent key meets nowhere.
    """
    out = df.withColumn("reason", F.lit(None).cast("string"))
    for i, check in enumerate(checks):
        whole = F.col("reason").isNull()
        for c in check.columns:
            whole = whole & F.col(c).isNotNull()
        names = [f"__{i}_{j}" for j in range(len(check.columns))]
        same = F.lit(True)
        for c, n in zip(check.columns, names, strict=True):
            same = same & (F.col(c) == F.col(n))
        if check.kind == "row":
            fails = F.col("reason").isNull() & ~check.holds
        elif check.kind == "unique":
            first = out.where(whole).groupBy(*[F.col(c).alias(n) for c, n in zip(check.columns, names, strict=True)]).agg(F.min(check.order).alias("__first"))
            out = out.join(first, same, "left")
            fails = whole & (F.col(check.order) != F.col("__first"))
        else:
            keys = check.parent.select(*[F.col(c).alias(n) for c, n in zip(check.parent_columns, names, strict=True)]).distinct().withColumn("__first", F.lit(1))
            out = out.join(keys, same, "left")
            fails = whole & F.col("__first").isNull()
        out = out.withColumn("reason", F.when(fails, check.name).otherwise(F.col("reason"))).drop("__first", *names)
    return out


def counted(rows: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, Observation]:
    """judged() rows that count themselves as they are written: rows, accepted, and one number for each check."""
    seen = Observation()
    numbers = [F.sum(F.when(F.col("reason") == c.name, 1).otherwise(0)).alias(c.name) for c in checks]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).alias("accepted"), *numbers), seen


def load(df: DataFrame, checks: Sequence[Check], path: str) -> dict[str, int]:
    """Judge df, write it in one pass under `path` (accepted=true and accepted=false, these with their reason) and return the counts of that pass."""
    rows, seen = counted(judged(df, checks), checks)
    rows.withColumn("accepted", F.col("reason").isNull()).write.mode("append").partitionBy("accepted").parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}


@dataclass(frozen=True)
class Link:
    """A foreign key from child to parent; what a delete does to its rows: cascade, set_null or refuse."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "cascade"


def ordered(tables: Sequence[str], links: Sequence[Link]) -> list[str]:
    """Tables, each after those it refers to; a cycle is a ValueError."""
    left, out = {t: {k.parent for k in links if k.child == t} for t in tables}, []
    while left:
        free = sorted(t for t, parents in left.items() if not parents & left.keys())
        if not free:
            raise ValueError(f"foreign keys in a circle: {', '.join(sorted(left))}")
        out += free
        for t in free:
            del left[t]
    return out


def delete(tables: Mapping[str, DataFrame], links: Sequence[Link], table: str, condition: Column) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(what stays, what goes) of each table when the rows of `table` that meet the condition are deleted.

    Going down the foreign keys, a child's rows whose parent goes go too
    (cascade), lose their key (set_null), or make the delete a ValueError
    (refuse). Each link is one semi join and one anti join on its key.
    """
    gone: dict[str, DataFrame] = {}
    stays: dict[str, DataFrame] = {}
    for name in ordered(list(tables), links):
        df = tables[name]
        hit = F.coalesce(condition, F.lit(False)) if name == table else F.lit(False)
        flags, nulls = [], {}
        for i, k in enumerate(k for k in links if k.child == name and k.parent in gone):
            flag = f"__gone{i}"
            keys = gone[k.parent].select(*[F.col(c).alias(f"__k{i}_{j}") for j, c in enumerate(k.parent_columns)]).distinct().withColumn(flag, F.lit(True))
            same = F.lit(True)
            for j, c in enumerate(k.columns):
                same = same & (F.col(c) == F.col(f"__k{i}_{j}"))
            df = df.join(keys, same, "left").drop(*[f"__k{i}_{j}" for j in range(len(k.columns))])
            flags.append(flag)
            there = F.coalesce(F.col(flag), F.lit(False))
            if k.on_delete == "cascade":
                hit = hit | there
            elif k.on_delete == "set_null":
                nulls |= {c: F.when(~there, F.col(c)) for c in k.columns}
            elif not df.where(there).isEmpty():
                raise ValueError(f"rows of {name} refer to deleted rows of {k.parent}")
        if name != table and not flags:
            stays[name] = df
            continue
        marked = df.withColumn("__hit", hit)
        gone[name] = marked.where("__hit").select(*tables[name].columns)
        rest = marked.where("not __hit")
        stays[name] = rest.withColumns(nulls).select(*tables[name].columns) if nulls else rest.select(*tables[name].columns)
    return stays, {t: gone.get(t, tables[t].limit(0)) for t in tables}

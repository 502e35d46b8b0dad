"""Row policies: who may do what to which rows of a table, compiled to filters and semi joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule is given the principal and says which rows it opens: a condition, or the table and columns of a semi join.
Rule = Callable[[object], "Column | Through"]


@dataclass(frozen=True)
class Through:
    """Rows whose `columns` are among the `keys` of another table's rows."""

    columns: tuple[str, ...]
    rows: DataFrame
    keys: tuple[str, ...]


@dataclass
class Policies:
    """F16: policies by (table, action), OR-ed: a row may be seen if any opens it.

    Without a policy nothing may be seen. A null principal is nobody: only
    rules declared for everybody hold. Rules about membership read the plain
    table that they are given, not its policed view, so they cannot call
    themselves.
    """

    rules: dict[tuple[str, str], list[tuple[Rule, bool]]] = field(default_factory=dict)

    def allow(self, table: str, action: str, rule: Rule, everybody: bool = False) -> None:
        self.rules.setdefault((table, action), []).append((rule, everybody))

    def rows(self, df: DataFrame, table: str, action: str, principal: object) -> DataFrame:
        """The rows of df, the named table, that the principal may apply the action to; each once."""
        open_, names = F.lit(False), []
        for i, (rule, everybody) in enumerate(self.rules.get((table, action), [])):
            if principal is None and not everybody:
                continue
            said = rule(principal)
            if isinstance(said, Through):
                keys = said.rows.select(*[F.col(k).alias(f"__{i}_{j}") for j, k in enumerate(said.keys)]).distinct().withColumn(f"__{i}", F.lit(True))
                same = F.lit(True)
                for j, c in enumerate(said.columns):
                    same = same & (F.col(c) == F.col(f"__{i}_{j}"))
                df = df.join(keys, same, "left")
                names += [f"__{i}", *(f"__{i}_{j}" for j in range(len(said.keys)))]
                said = F.col(f"__{i}")
            open_ = open_ | F.coalesce(said, F.lit(False))
        return df.where(open_).drop(*names)


def own(column: str) -> Rule:
    """Rows that name the principal."""
    return lambda principal: F.col(column) == F.lit(principal)


def member(people: DataFrame, who: str, role: Column, rule: Rule | None = None) -> Rule:
    """All rows (or those that `rule` opens) for principals that `people` says have the role; one look at that table."""

    def opened(principal: object) -> Column | Through:
        if people.where((F.col(who) == F.lit(principal)) & role).isEmpty():
            return F.lit(False)
        return rule(principal) if rule else F.lit(True)

    return opened

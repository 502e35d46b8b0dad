"""Declared factors: names with a source and a condition, compiled to one pass over each source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import astro
from orrery.operators import sky


@dataclass
class Factors:
    """What counts as a factor. A user adds to it by declare(); a name that is there already is a ValueError."""

    declared: dict[str, tuple[str, Column, str]] = field(default_factory=dict)

    def declare(self, name: str, source: str, condition: Column, date: str = "date") -> Factors:
        if name in self.declared:
            raise ValueError(f"factor {name} is declared already")
        self.declared[name] = (source, condition, date)
        return self

    def dates(self, sources: Mapping[str, DataFrame], names: Sequence[str] | None = None) -> DataFrame:
        """(factor, date), each once, of all factors or the named ones. Each source is read once: its rows give an array of the factors that hold."""
        wanted = {n: self.declared[n] for n in (self.declared if names is None else names)}
        if not wanted:
            raise ValueError("no factor is declared")
        parts = []
        for source, date in sorted({(s, d) for s, _, d in wanted.values()}):
            hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, (s, c, d) in wanted.items() if (s, d) == (source, date)]))
            parts.append(sources[source].select(F.explode(hits).alias("factor"), F.col(date).alias("date")))
        return reduce(DataFrame.unionByName, parts).distinct()


def given() -> Factors:
    """The forty factors that are always there: retrogrades, hard aspects of pairs, the Moon's place at 09:15, and gandanta."""
    out = Factors()
    for p in sky.STATIONS:
        out.declare(f"{p} Retrograde", "positions", (F.col("planet") == p) & F.col("retrograde"))
    for a, b in sky.PAIRS:
        out.declare(f"{a}-{b} Hard Aspect", "aspects", (F.col("planet_1") == a) & (F.col("planet_2") == b) & F.col("aspect_type").isin(sky.HARD))
    for name in astro.NAKSHATRAS:
        out.declare(f"Moon in {name}", "moon", (F.col("time_ist") == "09:15") & (F.col("nakshatra_name") == name))
    return out.declare("Moon Gandanta", "moon", F.col("gandanta"))

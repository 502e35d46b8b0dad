"""One rounding rule for the library: to the nearest, ties to even, of the scaled double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * float(10**digits)) / float(10**digits)

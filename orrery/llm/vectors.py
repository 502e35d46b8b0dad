"""Vectors as integers: each component x becomes floor(256 x)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Floors beyond this size are set to it, so that sums of 512 squared differences fit a long.
LIMIT = 1 << 26
#: Whole numbers that a double tells apart.
EXACT = float(1 << 52)


def sound_integers(column: pa.Array) -> list[bytes | None]:
    """Little-endian 32-bit floors of 256 x for each list of doubles; None for a list that is null or holds null or non-finite values."""
    lengths = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN, null lists have none
    ends = np.cumsum(lengths)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    lost = (bad[ends] != bad[ends - lengths]) | ~column.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        floors = np.clip(np.nan_to_num(np.floor(256 * values), nan=0, posinf=LIMIT, neginf=-LIMIT), -LIMIT, LIMIT)
    raw = floors.astype("<i4").tobytes()
    return [None if no else raw[4 * (end - n) : 4 * end] for no, end, n in zip(lost, ends, lengths, strict=True)]


def integers(df: DataFrame, keep: list[str], column: str = "embedding") -> DataFrame:
    """The columns `keep` and `ints` (binary, as sound_integers() gives it) of each row whose vector is not null and holds neither null nor non-finite components. Empty vectors stay."""
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").cast("array<double>").alias("ints"))
    names = rows.columns
    if not keep or "ints" in keep:
        raise ValueError("keep at least one column, and none named ints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = pa.array(sound_integers(batch.column(len(names) - 1)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ints], names=names).filter(ints.is_valid())

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-1]), "ints binary"])
    return rows.mapInArrow(run, schema)


def matrix(rows: list[bytes], kind: str = "<i4") -> np.ndarray:
    """Rows of one length as a matrix of 64-bit integers."""
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1 if rows and rows[0] else 0).astype(np.int64)

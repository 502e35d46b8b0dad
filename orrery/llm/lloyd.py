"""Vector codes: integer codebooks of vector parts by Lloyd rounds that Hamerly's bounds shorten."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows that one step of a task works on.
STEP = 4096
#: Bounds are widened by this share, far more than the rounding of a few double operations.
SLACK = 1e-12
#: Labels whose sums are broadcast; more are joined, with their rows dealt over SALTS tasks each.
FEW, SALTS = 50_000, 32


def part_width(dim: int, parts: int) -> int:
    return -(-dim // parts)


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as (n, parts, width); where the length is no multiple of parts, zeros follow the last component."""
    width = part_width(x.shape[1], parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of (n, width) rows to (m, width) entries, as 64-bit integers."""
    most = 2.0 * max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if most * most * max(1, x.shape[1]) < vectors.EXACT else np.int64  # sums of doubles are exact below EXACT
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


class Book:
    """One round's codebooks, with how far each entry moved and half the way to its nearest other entry."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries = entries  # (parts, entries, width)
        parts, many, _ = entries.shape
        moved = np.zeros((parts, many)) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
        top = np.argsort(-moved, axis=1, kind="stable")
        most = np.take_along_axis(moved, top, 1)
        self.moved = moved
        # the farthest that an entry other than the given one moved
        self.others = np.where(np.arange(many) == top[:, :1], most[:, 1:2] if many > 1 else 0.0, most[:, :1])
        self.half = np.full((parts, many), np.inf)
        for p in range(parts):
            d = np.sqrt(distances(entries[p], entries[p]).astype(np.float64)) * (1 - SLACK) / 2
            np.fill_diagonal(d, np.inf)
            self.half[p] = d.min(1)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry, the lower index where distances are equal, with bounds: at least the distance to it, at most that to the next."""
    d = distances(x, entries)
    code = d.argmin(1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, code].astype(np.float64)) * (1 + SLACK)
    rest = d.astype(np.float64)
    rest[rows, code] = np.inf
    return code.astype(np.uint8), upper, np.sqrt(rest.min(1)) * (1 - SLACK)


def reassign(x: np.ndarray, book: Book, p: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The assignment after the entries of part p moved, from that before, with new bounds and the number of full scans.

    A row keeps its entry only if its upper bound is strictly below the lower
    bound of all others, or below half the way to the nearest other entry; so
    where distances are equal a full scan in integers decides.
    """
    code, entries = code.copy(), book.entries[p]
    upper = (upper + book.moved[p][code]) * (1 + SLACK)
    lower = np.maximum(lower - book.others[p][code], 0) * (1 - SLACK)
    reach = np.maximum(lower, book.half[p][code])
    open_ = np.flatnonzero(~(upper < reach))
    if len(open_):  # the true distance is often enough
        gap = (x[open_] - entries[code[open_]]).astype(np.float64)
        upper[open_] = np.sqrt((gap * gap).sum(1)) * (1 + SLACK)
        open_ = open_[~(upper[open_] < reach[open_])]
    if len(open_):
        code[open_], upper[open_], lower[open_] = scan(x[open_], entries)
    return code, upper, lower, len(open_)


_STATE = "vec_id long, label {label}, ints binary, code binary, upper binary, lower binary"


def _assigned(rows: DataFrame, label: str, sent, parts: int) -> DataFrame:
    """rows with code, upper and lower bounds (a byte and two doubles a part); rows that have them already are reassigned."""
    fresh = "code" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = sent.value
        for whole in batches:
            for s in range(0, len(whole), STEP):
                batch = whole.slice(s, STEP)
                x = cut(vectors.matrix(batch.column("ints").to_pylist()), parts)
                n = len(x)
                if fresh:
                    found = [scan(x[:, p], book.entries[p]) for p in range(parts)]
                else:
                    code, upper, lower = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, parts) for c, t in (("code", "u1"), ("upper", "<f8"), ("lower", "<f8")))
                    found = [reassign(x[:, p], book, p, code[:, p], upper[:, p], lower[:, p])[:3] for p in range(parts)]
                code, upper, lower = (np.stack(c, 1) for c in zip(*found, strict=True))
                columns = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (code, upper.astype("<f8"), lower.astype("<f8"))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "ints")), *columns], names=["vec_id", "label", "ints", "code", "upper", "lower"])

    return rows.mapInArrow(run, _STATE.format(label=label))


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(cell, n, total) for each component of each entry: rows assigned to it and their sum; summed up in each task before any shuffle."""
    parts, many, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * many, np.int64), np.zeros((parts * many, width), np.int64)
        for whole in batches:
            for s in range(0, len(whole), STEP):
                batch = whole.slice(s, STEP)
                x = cut(vectors.matrix(batch.column("ints").to_pylist()), parts)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), "u1").reshape(len(x), parts)
                at = (code + np.arange(parts) * many).ravel()
                n += np.bincount(at, minlength=parts * many)
                np.add.at(total, at, x.reshape(len(at), width))
        used = np.flatnonzero(n)
        cells = (used[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.repeat(n[used], width)), pa.array(total[used].ravel())], names=["cell", "n", "total"])

    each = state.select("ints", "code").mapInArrow(run, "cell long, n long, total long")
    return each.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(30,0)")).alias("total"))


def books_digest(entries: np.ndarray, dim: int) -> str:
    """SHA-256 of all entries' components by part, entry and position, in decimal, joined by commas."""
    parts, _, width = entries.shape
    values = [str(int(v)) for p in range(parts) for e in entries[p] for v in e[: max(0, min(width, dim - p * width))]]
    return hashlib.sha256(",".join(values).encode()).hexdigest()


_RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row of (vec_id, embedding, label).

    Components are floor(256 x). The codebook of each part begins with that
    part of the rows with the least vec_id; each round assigns every row's part
    to its nearest entry, the lower index where two are as near, and moves each
    entry to the floor of its rows' mean. Assignments are kept from round to
    round with an upper bound to the own and a lower bound to the next nearest
    entry, both written to the shared folder; only rows whose bounds fail are
    compared with all entries, in integers. Only the codebooks, `entries`
    vectors, reach the driver.

    Vectors that are null or hold null or non-finite components are dropped;
    floors beyond 2^26 in size are set to it. The first vector sets the length,
    those of another length are dropped too; where it is no multiple of
    `parts`, the last parts are shorter or empty. Rows with a null vec_id come
    last, rows with equal ids in the order of their vectors' bytes; repeated
    rows each count. Null labels are one label. With fewer rows than `entries`
    all are entries. Sums beyond a long are set to its end. Other columns are
    not read. An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index must fit a byte")
    spark = df.sparkSession
    common.small_batches(spark)
    label = dict(df.dtypes)["label"]
    rows = common.written(vectors.integers(df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), ["vec_id", "label"]), "vector-ints")
    first = [bytes(r["ints"]) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(1).collect()]
    if not first:
        return spark.createDataFrame([], _RESULT)
    dim, rows = len(first[0]) // 4, rows.where(F.length("ints") == len(first[0]))
    first = [bytes(r["ints"]) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()]
    book = np.ascontiguousarray(cut(vectors.matrix(first), parts).transpose(1, 0, 2))
    sent, state = spark.sparkContext.broadcast(Book(book, None)), rows
    for _ in range(rounds):
        state = common.written(_assigned(state, label, sent, parts), "vector-codes")
        new = book.copy().reshape(-1)
        for r in _sums(state, book.shape).collect():  # as many as the codebooks have components
            new[r["cell"]] = int(r["total"]) // r["n"]
        before, book = book, new.reshape(book.shape)
        sent = spark.sparkContext.broadcast(Book(book, before))
    state = _assigned(state, label, sent, parts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries_ = sent.value.entries
        for whole in batches:
            for s in range(0, len(whole), STEP):
                batch = whole.slice(s, STEP)
                x = cut(vectors.matrix(batch.column("ints").to_pylist()), parts)
                raw = batch.column("code").to_pylist()
                code = np.frombuffer(b"".join(raw), "u1").reshape(len(x), parts)
                gap = x - entries_[np.arange(parts), code]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.hex() for c in raw]), pa.array((gap * gap).sum((1, 2)))], names=["vec_id", "label", "code", "error"])

    out = common.written(state.mapInArrow(coded, f"vec_id long, label {label}, code string, error long"), "vector-errors")
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = out.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(30,0)")), top).cast("long").alias("label_error"))
    sums = common.written(sums.withColumnRenamed("label", "label_"), "label-errors")
    same = F.col("label").eqNullSafe(F.col("label_"))
    if sums.count() <= FEW:
        out = out.join(F.broadcast(sums), same)
    else:
        sums = sums.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(sums, same & (F.col("salt") == F.col("salt_")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(book, dim)).alias("codebooks_sha256"))


def op12_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 16 parts for all embeddings; as compress() says."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Lloyd rounds with every row's part compared with every entry."""
    sql = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, e[p * len(e) // {parts} + 1:(p + 1) * len(e) // {parts}] AS e FROM v, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT x.p, f.i, x.e FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM v QUALIFY i < {entries}) f USING (vec_id)),"""
    for r in range(rounds + 1):
        sql += f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, x.p, x.e, b.i, list_dot_product(x.e, x.e) - 2 * list_dot_product(x.e, b.e) + list_dot_product(b.e, b.e) AS d FROM x JOIN b{r} b USING (p) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, b.i) = 1),"""
        if r < rounds:
            sql += f"""
m{r} AS (SELECT p, i, list(m ORDER BY j) AS e FROM (SELECT p, i, j, floor(sum(c) / count(*)) AS m FROM (SELECT p, i, unnest(e) AS c, unnest(range(len(e))) AS j FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS MATERIALIZED (SELECT p, i, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{r} m USING (p, i)),"""
    return (
        sql
        + f"""
s AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, i, j)) AS s FROM (SELECT p, i, unnest(e) AS c, unnest(range(len(e))) AS j FROM b{rounds})),
t AS (SELECT vec_id, label, string_agg(lower(format('{{:02x}}', i)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM t, s
"""
    )

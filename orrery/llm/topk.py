"""Exact top-k inner products: columnar branch and bound over chunks of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vectors

#: Dimensions of a block, candidates of a chunk, queries of one step, and bytes of queries that are broadcast at once.
BLOCK, CHUNK, STEP, BATCH = 8, 4096, 256, 8 << 20
#: Components that one task holds back before it writes chunks.
HELD = 1 << 22
#: Share of live pairs below which they go on as a list.
SPARSE = 0.125


def _chunk(rows: list[tuple[int | None, bytes]]) -> dict:
    """Candidates of one length in vertical layout: blocks of dimensions, those with most mass first, each dimension's values side by side."""
    x = vectors.matrix([v for _, v in rows])
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
    kind = "<i2" if not x.size or np.abs(x).max() < 1 << 15 else "<i4"
    blocks = [np.ascontiguousarray(x[:, order[j : j + BLOCK]].T.astype(kind)).tobytes() for j in range(0, x.shape[1], BLOCK)]
    return {"dim": x.shape[1], "kind": kind, "ids": [i for i, _ in rows], "dims": order.astype("<i4").tobytes(), "blocks": blocks}


_CHUNKS = "dim int, kind string, ids array<long>, dims binary, blocks array<binary>"
_CHUNK_TYPE = pa.schema([("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.list_(pa.int64())), ("dims", pa.binary()), ("blocks", pa.list_(pa.binary()))])


def _chunks(rows: DataFrame) -> DataFrame:
    """Chunks of at most CHUNK candidates of each task, all of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        many = 0
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("ints").to_pylist(), strict=True):
                own = held.setdefault(len(v), [])
                own.append((i, v))
                many += len(v) // 4 + 1
                if len(own) == CHUNK or many > HELD:
                    for n in [len(v)] if len(own) == CHUNK else list(held):
                        own = held.pop(n)
                        many -= len(own) * (n // 4 + 1)
                        yield pa.RecordBatch.from_pylist([_chunk(own)], _CHUNK_TYPE)
        for own in held.values():
            yield pa.RecordBatch.from_pylist([_chunk(own)], _CHUNK_TYPE)

    return rows.mapInArrow(run, _CHUNKS)


class Candidates:
    """A chunk ready to be searched: its blocks and what mass each candidate has after each block."""

    def __init__(self, chunk: dict):
        self.ids = np.array([0 if i is None else i for i in chunk["ids"]], np.int64)
        self.null = np.array([i is None for i in chunk["ids"]], bool)
        self.dims = np.frombuffer(chunk["dims"], "<i4")
        blocks = [np.frombuffer(b, chunk["kind"]).reshape(-1, len(self.ids)) for b in chunk["blocks"]]
        mass = [(b.astype(np.float64) ** 2).sum(0) for b in blocks]
        self.rest = _tails(mass, len(self.ids))
        self.norm = float(np.sqrt(sum(mass).max())) if mass and len(self.ids) else 0.0
        self.blocks = blocks


def _tails(mass: list[np.ndarray], n: int) -> list[np.ndarray]:
    """After each block, the root of the mass in the blocks to come."""
    out, total = [], np.zeros(n)
    for m in reversed(mass):
        out.append(np.sqrt(total))
        total = total + m
    return out[::-1]


def search(q: np.ndarray, own: np.ndarray, floor: np.ndarray, c: Candidates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of all pairs whose score reaches the query's floor; the query's own id is left out.

    Partial sums grow by a block of dimensions at a time. By Cauchy and Schwarz
    what is still to come is at most the product of the two remaining masses'
    roots, so a pair whose bound is below the floor is out for good; a pair that
    equals it stays, for ties go by id.
    """
    out = [(np.zeros(0, np.int64),) * 3]
    mass = float(np.sqrt((q.astype(np.float64) ** 2).sum(1).max())) if q.size else 0.0
    kind = np.float64 if mass * c.norm < vectors.EXACT else np.int64  # sums of doubles are exact below EXACT
    blocks = [b.astype(kind) for b in c.blocks]
    for s in range(0, len(q), STEP):
        x, low = q[s : s + STEP][:, c.dims].astype(kind), floor[s : s + STEP]
        parts = [x[:, j : j + BLOCK] for j in range(0, x.shape[1], BLOCK)]
        rest = _tails([(p.astype(np.float64) ** 2).sum(1) for p in parts], len(x))
        total, pairs = np.zeros((len(x), len(c.ids)), kind), None
        for j, (p, b) in enumerate(zip(parts, blocks, strict=True)):
            slack = 1 + 1e-9
            if pairs is None:
                total += p @ b
                alive = total + (rest[j] * slack)[:, None] * c.rest[j] + 1e-3 >= low[:, None]
                if j + 1 == len(parts) or alive.mean() <= SPARSE:
                    pairs = np.nonzero(alive)
                    score = total[pairs]
            else:
                i, k = pairs
                score = score + (p[i] * b.T[k]).sum(1)
                alive = score + rest[j][i] * slack * c.rest[j][k] + 1e-3 >= low[i]
                pairs, score = (i[alive], k[alive]), score[alive]
        if pairs is None:  # vectors without components
            pairs = np.nonzero(total >= low[:, None])
            score = total[pairs]
        i, k = pairs
        there = (score >= low[i]) & ((c.ids[k] != own[s : s + STEP][i]) | c.null[k])
        out.append((i[there] + s, k[there], score[there].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Best:
    """The k best candidates of each query so far: by score, then by id, null last."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor, k
        self.found = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        q, s, i, n = (np.concatenate(x) for x in zip(self.found, (query, score, ids, null), strict=True))
        by = np.lexsort((i, n, -s, q))
        q, s, i, n = q[by], s[by], i[by], n[by]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        keep = rank < self.k
        self.found = (q[keep], s[keep], i[keep], n[keep])


def _floors(chunk: dict | None, k: int):
    """Floor of each query from one chunk: the k-th best score there, which the k-th best of all cannot be below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Candidates(chunk.value) if chunk else None
        for batch in batches:
            rows = batch.column("ints").to_pylist()
            low = np.full(len(rows), -np.inf)
            at = np.array([j for j, r in enumerate(rows) if c and len(r) == 4 * len(c.dims)], np.int64)
            if len(at):
                best = Best(np.full(len(at), -np.inf), k)
                i, j, score = search(vectors.matrix([rows[x] for x in at]), batch.column("query_id").to_numpy()[at], best.floor, c)
                best.add(i, score, c.ids[j], c.null[j])
                low[at] = best.floor
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low)], names=[*batch.schema.names, "floor"])

    return run


def _searcher(asked, k: int):
    """The k best of a task's chunks for each query of the broadcast batch, as far as they reach its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = {}
        for r, (_, ints, _) in enumerate(asked.value):
            by_dim.setdefault(len(ints) // 4, []).append(r)
        kinds = {}
        for dim, at in by_dim.items():
            rows = [asked.value[r] for r in at]
            kinds[dim] = (np.array(at), vectors.matrix([v for _, v, _ in rows]), np.array([i for i, _, _ in rows]), Best(np.array([f for _, _, f in rows], np.float64), k))
        for batch in batches:
            for n in range(len(batch)):
                chunk = batch.slice(n, 1).to_pylist()[0]
                if chunk["dim"] in kinds:
                    _, q, own, best = kinds[chunk["dim"]]
                    c = Candidates(chunk)
                    i, j, score = search(q, own, best.floor, c)
                    best.add(i, score, c.ids[j], c.null[j])
        for at, _, _, best in kinds.values():
            q, s, i, null = best.found
            yield pa.RecordBatch.from_arrays([pa.array(at[q]), pa.array(i, mask=null), pa.array(s)], names=["q", "vec_id", "score"])

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) with the k rows of highest integer inner product for each row that `is_query` picks.

    Candidates are all rows but those with the query's own vec_id; components
    are floor(256 x). Every row lies in one chunk, in vertical layout, written
    once. Queries come in batches of at most twice BATCH bytes, broadcast; each
    task keeps k rows a query, and a window over these picks the k best. Floors
    from one chunk spare most of the work and all are certain, so the result is
    exact. Nothing is compared but queries with candidates.

    Vectors that are null or hold null or non-finite components take no part;
    floors beyond 2^26 in size are set to it. Vectors of different length are
    not compared; vectors without components have score 0 with one another.
    Ties go to the smaller vec_id, a null one last. Equal ids are one another's
    own rows; repeated query rows give their rows again; a null id is no query.
    Other columns are not read. An empty table gives no rows.
    """
    spark = df.sparkSession
    common.small_batches(spark)
    own = F.col("vec_id").cast("long")
    chunks = common.written(_chunks(vectors.integers(df.select(own.alias("vec_id"), "embedding"), ["vec_id"])), "vector-columns")
    asked = df.where(is_query & own.isNotNull()).select(own.alias("query_id"), "embedding")
    asked = vectors.integers(asked, ["query_id"]).groupBy("query_id", "ints").agg(F.count("*").alias("many"))
    some = chunks.limit(1).collect()
    seed = spark.sparkContext.broadcast(some[0].asDict()) if some else None
    asked = common.written(asked.mapInArrow(_floors(seed, k), "query_id long, ints binary, many long, floor double"), "queries")
    weight = F.length("ints") + 64
    batches = 1 + (asked.agg(F.sum(weight)).first()[0] or 0) // BATCH
    key = lambda: F.pmod(F.xxhash64("query_id", "ints"), F.lit(batches))
    while asked.groupBy(key().alias("b")).agg(F.sum(weight).alias("w")).where(F.col("w") > 2 * BATCH).limit(1).count() and batches < asked.count():
        batches *= 2
    out = []
    for b in range(batches):
        rows = asked.where(key() == b).collect()  # at most twice BATCH bytes
        if rows:
            sent = spark.sparkContext.broadcast([(r["query_id"], bytes(r["ints"]), r["floor"]) for r in rows])
            found = chunks.mapInArrow(_searcher(sent, k), "q long, vec_id long, score long")
            order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, r["query_id"], r["many"]) for i, r in enumerate(rows)], "q long, query_id long, many long")
            out.append(common.written(found.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score", "many"), "top"))
            sent.destroy()
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    both = reduce(DataFrame.union, out)
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many")))).select("query_id", "rank", "vec_id", "score")


def op11_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for every one whose vec_id is divisible by 50; as top_k() says."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: All pairs of a query and another row of one length.
OP11_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: greatest(-67108864, least(67108864, floor(256 * CAST(x AS DOUBLE))))) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 THEN 0 ELSE CAST(list_dot_product(q.e, c.e) AS BIGINT) END AS score
 FROM v q JOIN v c ON q.vec_id % 50 = 0 AND len(q.e) = len(c.e) AND c.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 5
"""

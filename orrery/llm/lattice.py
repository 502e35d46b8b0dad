"""Near-duplicate embeddings by lattice hashing: E8 cells of random projections in several tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textpack

#: Tables, E8 lattices in each, neighbouring cells probed, and how far projections are spread over the lattice.
TABLES, LATTICES, PROBES, SCALE = 4, 2, 2, 3.0
#: Rows of a cell that one task compares; a larger cell is split into blocks, and its rows go to each pair of blocks with their own.
BLOCK = 2048


def shortest_vectors() -> np.ndarray:
    """The 240 lattice vectors next to the origin: two coordinates +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where rounding gives an odd sum, the worst coordinate is rounded the other way."""
    r = np.rint(x)
    d = x - r
    k = np.abs(d).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(d, k, -1) >= 0, 1.0, -1.0) * (np.abs(r.sum(-1, keepdims=True)) % 2)
    np.put_along_axis(r, k, np.take_along_axis(r, k, -1) + step, -1)
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point: the nearer of the even-sum integer point and its coset shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[..., None], a, b)


class Lattice:
    """Cells of unit vectors of one dimension: `cells` gives (n, tables, 1 + probes) hashes, the home cell first."""

    def __init__(self, dim: int, tables: int, lattices: int, probes: int, scale: float, seed: int):
        rng = np.random.Generator(np.random.PCG64([seed, dim]))
        width = 8 * lattices
        self.maps = []
        for _ in range(tables):
            m = rng.normal(size=(max(dim, width), width))
            self.maps.append(np.linalg.qr(m)[0][:dim] * scale * np.sqrt(max(dim, width) / 64))
        self.lattices, self.probes, self.dim = lattices, probes, dim
        self.near = shortest_vectors()
        self.steps = np.random.Generator(np.random.PCG64(seed + 1)).integers(1, 1 << 62, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _hash(self, points: np.ndarray, table: int) -> np.ndarray:
        h = ((2 * points).astype(np.int64).view(np.uint64).reshape(len(points), -1) * self.steps).sum(1, dtype=np.uint64)
        return textpack.mix(h + np.uint64(table * 1_000_003 + self.dim)).view(np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.maps), 1 + self.probes), np.int64)
        for t, m in enumerate(self.maps):
            y = (x @ m).reshape(len(x), self.lattices, 8)
            home = nearest(y)
            out[:, t, 0] = self._hash(home, t)
            if self.probes:
                toward = ((y - home) @ self.near.T).reshape(len(x), -1)  # the neighbours that a vector leans to most
                best = np.argsort(-toward, axis=1, kind="stable")[:, : self.probes]
                for q in range(self.probes):
                    point = home.copy()
                    point[np.arange(len(x)), best[:, q] // len(self.near)] += self.near[best[:, q] % len(self.near)]
                    out[:, t, 1 + q] = self._hash(point, t)
        return out


_lattices: dict[tuple, Lattice] = {}


def _lattice(dim: int, options: tuple) -> Lattice:
    if (dim, options) not in _lattices:
        _lattices[dim, options] = Lattice(dim, *options)
    return _lattices[dim, options]


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(rows: list[bytes], kind: str) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1))


def _with_cells(classes: DataFrame, options: tuple, kind: str) -> DataFrame:
    """(key, lid, many, vector, cells): each class of vectors with its cells of all tables, its own before those probed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                rows = [np.array(v, kind).tobytes() for v in part.column("embedding").to_pylist()]
                lid = part.column("lid").to_numpy()
                size, cells = np.array([len(v) for v in rows]), [None] * len(rows)
                for n in np.unique(size):
                    k = np.flatnonzero(size == n)
                    found = _lattice(int(n) // np.dtype(kind).itemsize, options).cells(_vectors([rows[j] for j in k], kind))
                    found = textpack.mix(found.view(np.uint64) ^ textpack.mix(lid[k].view(np.uint64) + np.uint64(1))[:, None, None]).view(np.int64)
                    for j, c in zip(k, found.reshape(len(k), -1), strict=True):
                        cells[j] = c
                columns = [*(part.column(c) for c in ("key", "lid", "many")), pa.array(rows, pa.binary()), pa.array(cells, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "lid", "many", "vector", "cells"])

    return classes.mapInArrow(run, "key long, lid long, many long, vector binary, cells array<long>")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's component, of pairs inside one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_FOUND = ("key", "links", "other")


def _links(table: pa.Table, cosine: float, options: tuple, kind: str) -> pa.Table:
    """For each class linked in these cells: how many vectors it links to that no earlier table finds, and a class of its component."""
    cell, lo, hi = (table.column(c).to_numpy() for c in ("cell", "lo", "hi"))
    order = np.lexsort((hi, lo, cell))
    cell, lo, hi = cell[order], lo[order], hi[order]
    cut = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
    rows = table.column("vector")
    block, key, lid, many, home, t = (table.column(c).to_numpy()[order] for c in ("block", "key", "lid", "many", "home", "t"))
    out = [(np.zeros(0, np.int64),) * 3]
    for i, j in zip(cut, np.append(cut[1:], len(cell)), strict=True):
        if j - i > 1 and home[i:j].any():
            own = rows.take(pa.array(order[i:j])).to_pylist()
            if len({len(r) for r in own}) == 1:
                out.append(_cell_links(_vectors(own, kind), *(c[i:j] for c in (block, key, lid, many, home)), int(t[i]), lo[i] != hi[i], cosine, options))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=list(_FOUND))


def _near(x: np.ndarray, cosine: float, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rows near enough with i < first, a few rows at a time."""
    found = [(np.zeros(0, np.int64),) * 2]
    for s in range(0, first, 256):
        i, j = np.nonzero(x[s : min(s + 256, first)] @ x[s:].T >= cosine)
        found.append((i[i < j] + s, j[i < j] + s))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _cell_links(x, block, key, lid, many, home, t: int, crossed: bool, cosine: float, options: tuple) -> tuple[np.ndarray, ...]:
    none = (np.zeros(0, np.int64),) * 3
    first = len(x)
    if crossed:  # two blocks: only pairs between them, so one of them is enough for the left side
        by = np.argsort(block, kind="stable")
        x, block, key, lid, many, home = (c[by] for c in (x, block, key, lid, many, home))
        first = int((block == block[0]).sum())
    i, j = _near(x, cosine, first)
    found = (home[i] | home[j]) & (key[i] != key[j]) & (lid[i] == lid[j]) & ((block[i] != block[j]) if crossed else True)
    i, j = i[found], j[found]
    if not len(i):
        return none
    swap = key[i] > key[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    used, inv = np.unique(np.concatenate([i, j]), return_inverse=True)
    cells = _lattice(x.shape[1], options).cells(x[used])
    own, probed = cells[:, :, 0], cells[:, :, 1:]
    i_, j_ = inv[: len(i)], inv[len(i) :]
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 100_000):
        a, b = i_[s : s + 100_000], j_[s : s + 100_000]
        same = own[a] == own[b]
        from_b = same | (probed[b] == own[a][:, :, None]).any(2)  # b reaches a's home cell
        from_a = same | (probed[a] == own[b][:, :, None]).any(2)
        # in this table the pair counts in the first one's home cell if the second reaches it, else in the second's
        here = (home[i[s : s + 100_000]] & from_b[:, t]) | (home[j[s : s + 100_000]] & ~from_b[:, t])
        keep[s : s + 100_000] = here & ~(from_a | from_b)[:, :t].any(1)
    i, j = i[keep], j[keep]
    if not len(i):
        return none
    links = np.bincount(i, many[j], len(x)) + np.bincount(j, many[i], len(x))
    root = _roots(len(x), i, j)
    some = np.flatnonzero(links)
    return key[some], links[some].astype(np.int64), key[root[some]]


def _numbered(rows: DataFrame, most_tries: int = 20) -> tuple[DataFrame, DataFrame]:
    """rows with a number `key` for each (label, embedding) that is to be searched, and (key, lid, label, many, least, embedding) of these classes.

    Numbers are hashes of the values; if two values share one, all are taken
    again with another seed. So equal numbers mean equal values.
    """
    for seed in range(most_tries):
        hashed = lambda *c, seed=seed: F.xxhash64(F.lit(seed), *c)
        whole = rows.withColumn("key", F.when(F.col("sound"), hashed("label", "embedding")))
        classes = whole.where("sound").groupBy("label", "embedding").agg(F.min("key").alias("key"), F.count("*").alias("many"), F.min("vec_id").alias("least"))
        classes = common.written(classes.select("key", hashed("label").alias("lid"), "label", "many", "least", "embedding"), "vector-classes")
        seen = classes.agg(F.count("*").alias("n"), F.countDistinct("key").alias("k")).first()
        labels = classes.groupBy("label").agg(F.min("lid").alias("lid")).agg(F.count("*").alias("n"), F.countDistinct("lid").alias("k")).first()
        if seen["n"] == seen["k"] and labels["n"] == labels["k"]:
            return whole, classes
        common.drop_written(classes)
    raise RuntimeError("no seed tells all labels and vectors apart")


def near_duplicates(
    df: DataFrame,
    cosine: float = 0.93,
    tables: int = TABLES,
    lattices: int = LATTICES,
    probes: int = PROBES,
    scale: float = SCALE,
    seed: int = 5,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Two rows link when their labels are equal and not null and their cosine, in
    double precision, is at least `cosine`; pairs are found if a table puts
    them into one E8 cell or one probes the other's. Equal rows of (label,
    embedding) are one class and need no search. Each link is counted in the
    first table that finds it, so no pair leaves a task, and a cell of any
    size is compared by pairs of blocks: nothing is capped. For larger inputs
    raise `lattices` (finer cells) and with it `tables`.

    Labels of any type that can be grouped are compared as they are. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows
    without a label, link with nothing. Vectors of different length never link. Repeated rows count as vectors of their own; component_id is
    the least vec_id that is not null. Other columns are not read. An empty
    table gives no rows.
    """
    options = (tables, lattices, probes, scale, seed)
    spark = df.sparkSession
    common.small_batches(spark)
    kind = "<f4" if dict(df.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = df.select("vec_id", F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    sound = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    rows, classes = _numbered(rows.withColumn("sound", sound))
    ids = common.written(rows.select("vec_id", "key"), "vectors")
    hashed = common.written(_with_cells(classes.select("key", "lid", "many", "embedding"), options, kind), "cells")
    big = hashed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    big = common.written(big.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "big-cells")
    few = big.count() <= 100_000
    each = hashed.select("key", "lid", "many", "vector", F.posexplode("cells").alias("at", "cell"))
    dealt = each.join(F.broadcast(big) if few else big, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.hash("key"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"t": F.expr(f"cast(at div {1 + probes} as int)"), "home": F.col("at") % (1 + probes) == 0})
    dealt = dealt.select("cell", "t", "home", "key", "lid", "many", "vector", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    parts = max(common.partitions(spark, 4), classes.count() * tables * (1 + probes) // 4000)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cell", "lo", "hi"), F.lit(parts)))
    found = dealt.groupBy("part").applyInArrow(lambda table: _links(table, cosine, options, kind), "key long, links long, other long")
    found = common.written(found, "cell-links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    parts = common.connected_components(found, "key", "other").withColumnRenamed("node", "key")
    named = classes.select("key", "many", "least").join(counts, "key", "left").join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("key", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = ids.join(common.written(named, "vector-components"), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; as near_duplicates() says."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

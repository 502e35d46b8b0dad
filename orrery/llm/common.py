"""Shared pieces: lineage cuts in the shared folder, classes of equal rows, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a new local one on a single machine (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting that shuffle files go as soon as the query that wrote them ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, freed: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back, so that a lost executor costs no recomputation.

    freed: its shuffle files are gone once it is written. Else they go when the
    cleaner finds them, which is often only after the next query.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, "false")
    try:
        spark.conf.set(FREED, "true" if freed else before)
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    spark._jvm.System.gc()  # the cleaner drops the shuffle files of jobs that nothing refers to any more
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove a table that written() made, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch that Python gets. Spark's own bound, 64 MB, is held several times over in each worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session to BATCH_BYTES, unless it has a smaller bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession, times: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the ids that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def repeated(df: DataFrame, copies: str, most: int = 1 << 16) -> DataFrame:
    """Each row as often as its column `copies` says (0 or null: not at all), without that column; no list is longer than `most`, unless copies exceed its square."""
    block, at = free_names(df.columns, "block", "at")
    df = df.where(F.col(copies) > 0).withColumn(block, F.explode(F.expr(f"sequence(0L, ({copies} - 1) div {most})")))
    df = df.withColumn(at, F.explode(F.expr(f"sequence(1L, least({most}L, {copies} - {block} * {most}))")))
    return df.drop(block, at, copies)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it unlike all columns (in any case) and one another."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ordered_ids(docs: DataFrame, null_first: bool = False, column: str = "doc_id") -> tuple[Column, Callable[[Column], Column]]:
    """A long for each id, in the ids' order, with null before or after all others; and the way back.

    Null gets the extreme long. Where an id has that value, the ids between it
    and a long that no row has are shifted by one to make room.
    """
    end = -(1 << 63) if null_first else (1 << 63) - 1
    free, step = end, 0x9E3779B97F4A7C15 >> 2
    while not docs.where(F.col(column) == F.lit(free)).isEmpty():
        free = (free + step + (1 << 63)) % (1 << 64) - (1 << 63)
    beyond = (lambda x: x < free) if null_first else (lambda x: x > free)
    shift = 1 if null_first else -1
    there = F.col(column)
    there = F.coalesce(F.when(beyond(there), there + F.lit(shift)).otherwise(there), F.lit(end))
    # a shifted id is next to its old value, so the free long itself is reached only by a shift
    moved = (lambda x: x <= free) if null_first else (lambda x: x >= free)
    back = lambda x: F.when(x != end, F.when(moved(x), x - F.lit(shift)).otherwise(x)) if free != end else F.when(x != end, x)
    return there.cast("long"), back


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the least node reachable, for every node of an edge table.

    Alternates the large-star and small-star steps, which need a logarithmic
    number of rounds on chains too, and writes each round's edges to the shared
    folder. Rows, not components, are dealt to tasks: a hub's edges are summed
    up by min() before any shuffle. Rounds go on until no edge changes; each
    but the last lowers some node's neighbour, so they end. Null ends and loops
    are ignored; repeated edges count once. An empty edge table gives no rows.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node's smaller neighbours, and itself, go to its least neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "edges")
        drop_written(now)
        now = new
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"), F.countDistinct("u").alias("d")).first()
        if state == tuple(seen) or seen["n"] == 0:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", F.col("v").alias("component")).distinct())

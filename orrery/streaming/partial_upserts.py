"""A table that a stream of partial rows is merged into: each batch rewrites only the partitions it touches.

Layout under the table's folder:
  data/batch=N/__part=P/   the rows of partition P as batch N left them
  versions/N/              (part, batch): where each partition's rows are after batch N
A version counts once its writer has finished it. Files are never changed, so a
reader of an older version is not disturbed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.upsert import merge_columns

_VERSION = "part string, batch bigint"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest(spark: SparkSession, path: str) -> int | None:
    """The last finished version's batch."""
    folder, fs = _folder(spark, f"{path}/versions")
    if not fs.exists(folder):
        return None
    done = [int(x.getPath().getName()) for x in fs.listStatus(folder) if fs.exists(_folder(spark, f"{x.getPath().toString()}/_SUCCESS")[0])]
    return max(done, default=None)


def _parts(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    return spark.createDataFrame([], _VERSION) if version is None else spark.read.schema(_VERSION).parquet(f"{path}/versions/{version}")


def _rows(spark: SparkSession, path: str, schema: T.StructType, parts: list) -> DataFrame:
    """The rows of the given (part, batch); only their folders are listed and read."""
    if not parts:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("__part", T.StringType())])
    paths = [f"{path}/data/batch={r['batch']}/__part={r['part']}" for r in parts]
    return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*paths).select(*schema.names)


def read_table(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
    """The table after the newest or a given batch, or only some of its partitions."""
    there = _parts(spark, path, newest(spark, path) if version is None else version)
    if parts is not None:
        there = there.where(F.col("part").isin(*parts) if parts else F.lit(False))
    return _rows(spark, path, schema, there.collect())  # a row for each partition


def merge_batch(path: str, schema: T.StructType, key: Sequence[str], order: str, part: Column, batch: DataFrame, number: int) -> None:
    """Merge one batch: columns that it has overwrite, those that it lacks keep their values, of rows with one key the last by `order` counts.

    `part` must follow from the key, so that a row stays in its partition; a
    null part is the partition `none`. A batch that a finished version has
    already changes nothing; one that was broken off is written again.
    """
    spark = batch.sparkSession
    last = newest(spark, path)
    if last is not None and last >= number:
        return
    rows = batch.withColumn("__part", F.coalesce(part.cast("string"), F.lit("none")))
    touched = [r[0] for r in rows.select("__part").distinct().collect()]  # partitions of one batch
    if not touched:
        return
    before = _parts(spark, path, last)
    old = _rows(spark, path, schema, before.where(F.col("part").isin(*touched)).collect())
    out = merge_columns(old, rows.drop("__part"), key, order).withColumn("__part", F.coalesce(part.cast("string"), F.lit("none")))
    out.repartition(F.col("__part")).write.mode("overwrite").partitionBy("__part").parquet(f"{path}/data/batch={number}")
    now = spark.createDataFrame([(p, number) for p in touched], _VERSION)
    now.union(before.where(~F.col("part").isin(*touched))).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{number}")


def start_partial_upserts(stream: DataFrame, path: str, checkpoint: str, schema: T.StructType, key: Sequence[str], order: str, part: Column) -> StreamingQuery:
    """merge_batch() for each batch of a stream."""
    merge = lambda batch, number: merge_batch(path, schema, key, order, part, batch, number)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_unread(spark: SparkSession, path: str) -> int:
    """Remove partitions' rows that the newest version does not hold; returns how many folders went."""
    held = {(r["part"], r["batch"]) for r in _parts(spark, path, newest(spark, path)).collect()}
    folder, fs = _folder(spark, f"{path}/data")
    gone = 0
    for batch in fs.listStatus(folder) if fs.exists(folder) else []:
        number = int(batch.getPath().getName().removeprefix("batch="))
        for p in fs.listStatus(batch.getPath()):
            name = p.getPath().getName()
            if name.startswith("__part=") and (name.removeprefix("__part="), number) not in held:
                fs.delete(p.getPath(), True)
                gone += 1
    return gone

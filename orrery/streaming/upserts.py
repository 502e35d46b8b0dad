"""Incremental bars: a stream of row batches merged into a table of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.upsert import insert_or_replace


def drop_version(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def start_upserts(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], order: str, versions: int = 2) -> StreamingQuery:
    """Each batch is merged with the newest version under `path` and written as the next; a batch seen again writes its version again.

    The last `versions` versions stay, at least two: a repeated batch reads the one before it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else batch.limit(0)
        insert_or_replace(old, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{number}")
        if number >= max(versions, 2):
            drop_version(spark, f"{path}/v{number - max(versions, 2)}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Proportional stratified interleaving into shards, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def interleave(
    df: DataFrame,
    n_shards: int,
    stratum: Column,
    order_key: Column,
    rows_per_bucket: int = 2000,
) -> DataFrame:
    """Add shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 in each shard).

    Rows are ranked by `order_key` (a seeded hash as a hex string, uniform in
    its first digits) inside their stratum, sorted by the fractional rank
    (rank - shift) / stratum size, and the sorted sequence is cut into n_shards
    runs whose lengths differ by one row at most. Each run so holds each
    stratum's share, to within a few rows.

    Neither sort meets in one task: ranks are counted inside hash buckets, so a
    stratum with a third of all rows is dealt to many tasks, and the buckets'
    row counts (one row a bucket) give the offsets.

    Nulls: a null stratum is a stratum of its own. Ties in order_key follow
    the row's other columns' hash; rows equal in all columns are
    interchangeable (and, having one key, share a bucket). An empty table gives an empty result. Existing columns
    shard and slot are replaced; helper columns have names that no column has.
    """
    df = df.drop("shard", "slot")
    cols = df.columns
    n = df.count()
    s_, k_, t_, b_, c_, before_, n_, f_, g_, p_ = common.free_names([*cols, "shard", "slot"], "s", "k", "t", "b", "c", "before", "n", "f", "g", "p")
    digits = 3 if n <= 4096 * rows_per_bucket else 5  # 4,096 or 1,048,576 hash buckets
    fine = min(1 << 20, max(256, n // rows_per_bucket))
    rows = df.withColumns({s_: stratum, k_: order_key, t_: F.xxhash64(*[F.col(f"`{c}`") for c in cols])})
    rows = rows.withColumns({b_: F.conv(F.substring(k_, 1, digits), 16, 10).cast("int"), s_: F.coalesce(F.concat(F.lit("="), F.col(s_).cast("string")), F.lit(""))})
    counts = rows.groupBy(s_, b_).agg(F.count("*").alias(c_))
    of = Window.partitionBy(s_)
    counts = counts.withColumns({
        before_: F.sum(c_).over(of.orderBy(b_).rowsBetween(Window.unboundedPreceding, -1)),
        n_: F.sum(c_).over(of),
    }).fillna(0, [before_]).drop(c_)
    rows = rows.join(counts.hint("shuffle_hash"), [s_, b_])
    rank = F.row_number().over(Window.partitionBy(s_, b_).orderBy(k_, t_)) + F.col(before_)
    # each stratum is shifted by a part of a rank of its own, so that small strata do not all fall into the middle
    shift = F.conv(F.substring(F.md5(s_), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn(f_, (rank - shift) / F.col(n_)).drop(b_, before_, n_)
    rows = rows.withColumn(g_, F.least(F.floor(F.col(f_) * fine), F.lit(fine - 1)).cast("int"))
    starts = rows.groupBy(g_).agg(F.count("*").alias(c_))
    starts = starts.withColumn(before_, F.coalesce(F.sum(c_).over(Window.orderBy(g_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(c_)
    rows = rows.join(starts.hint("shuffle_hash"), g_)
    at = F.row_number().over(Window.partitionBy(g_).orderBy(f_, k_, s_, t_)) - 1 + F.col(before_)
    rows = rows.withColumn(p_, at.cast("long"))
    rows = rows.withColumn("shard", F.expr(f"cast({p_} * {n_shards} div {max(n, 1)} as int)"))
    return rows.withColumn("slot", F.expr(f"{p_} - (cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}")).select(*[f"`{c}`" for c in cols], "shard", "slot")


def op2_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """All documents in shards by the law `rows`; only ids, sizes and checksums are shuffled, never the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = common.documents(spark, sf_dir).select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32"), "source")
    rows = rows.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", "source")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    out = interleave(rows, n_shards, F.col("source"), key)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")

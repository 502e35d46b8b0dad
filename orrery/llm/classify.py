"""What the two text classifiers share: bounded samples of labelled rows, and scoring in Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textpack


def hash_sample(ids: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most `most` rows, those least by a hash of the key: a filter by the hash thins the rows first, so that no task gathers more than a few times `most`."""
    n = ids.count()
    order = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    share = min(1.0, 1.5 * most / max(n, 1) + 0.001)
    return ids.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.pmod(order, F.lit(1 << 20)), order, key).limit(most)


def training_labels(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from: not held out, label 0 or 1; the larger of a document's labels."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~common.held_out("doc_id"))
    return rows.groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))


def texts_of(docs: DataFrame, ids: DataFrame, label: str = "label") -> DataFrame:
    """(text, label) of the documents with these ids; `ids` is a sample of bounded size, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", label)), "doc_id").select("text", label)


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. score: bytes and offsets of a pack to a number from 0 to 1 for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in textpack.slices(batch, "text"):
                out = pa.array(score(buf, offs), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), out], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

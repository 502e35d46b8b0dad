"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, common, textpack

#: At most so many labelled texts of either label are the rows of the logistic fit. The ratios are counted over all labelled texts.
MOST_TEXTS = 1_500
SIZES = (3, 4, 5, 6)
#: Every one of the 2**BITS hash buckets of n-grams whose ratio is more than chance is a feature.
BITS = 20
#: Standard errors that the ratios are lessened by, and weight decay of the fit: chosen by compared() on training rows alone.
ERRORS, DECAY = 3.0, 3e-5
#: Up to so many labels (some 16 MB) are broadcast to the documents, more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
_STEP = np.uint64(0x2545F4914F6CDD1D)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str, bits: int = BITS) -> np.ndarray:
    """A hash bucket for each character n-gram of the text in lower case, with a space before and after."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], c
    for n in range(2, max(SIZES) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * _STEP + c[n - 1 :]
        if n in SIZES:
            out.append(((h + np.uint64(n)) * _SPREAD) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def class_counts(texts: DataFrame) -> DataFrame:
    """(bucket, pos, neg): the texts of either label that have the bucket, summed up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, label in zip(_texts(batch.column("text")), batch.column("label").to_pylist(), strict=True):
                count[label][np.unique(buckets(text))] += 1
        some = np.flatnonzero(count.any(0))
        for i in range(0, len(some), 50_000):
            k = some[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, count[1, k], count[0, k])], names=["bucket", "pos", "neg"])

    return texts.mapInArrow(run, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, smooth: float = 1.0) -> np.ndarray:
    return np.log((pos + smooth) / (n_pos + 2 * smooth)) - np.log((neg + smooth) / (n_neg + 2 * smooth))


def shrunk(ratios: np.ndarray, pos: np.ndarray, neg: np.ndarray, errors: float = ERRORS) -> np.ndarray:
    """Ratios less what chance can make of them: r * max(0, 1 - (errors * standard error / r)**2)."""
    error = 1 / (pos + 1) + 1 / (neg + 1)
    return ratios * np.maximum(0, 1 - errors**2 * error / np.maximum(ratios**2, 1e-12))


def _rows(texts: DataFrame, used: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Used buckets of each text of the sample and its label, gathered on the driver: 4 bytes for each distinct bucket of MOST_TEXTS texts a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in _texts(batch.column("text")):
                k = buckets(text)
                out.append(np.unique(k[used[k]]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column("label").cast(pa.int32())], names=["x", "label"])

    table = texts.mapInArrow(run, "x binary, label int").toArrow()
    x = [np.frombuffer(r, "<u4") for r in table.column("x").to_pylist()]
    y = np.array(table.column("label").to_pylist(), float)
    order = sorted(range(len(x)), key=lambda i: (y[i], x[i].tobytes()))  # the order that rows arrive in shall not matter
    return [x[i] for i in order], y[order]


def fit(x: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, share: float, epochs: int = 12, size: int = 100, rate: float = 0.03, decay: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights of the buckets (with the ratios multiplied in) and the intercept, by logistic regression on the scaled features.

    Rows are weighted so that label 1 has `share` of the weight, whatever its
    part of the sample. Batches of `size` rows, so that a batch is all that is
    unpacked.
    """
    w, b = np.zeros(len(ratios), np.float32), float(np.log(share / (1 - share)))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    if not len(y):
        return w, b
    r = ratios.astype(np.float32)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    mixed, t = np.random.Generator(np.random.PCG64(11)), 0
    for _ in range(epochs):
        order = mixed.permutation(len(y))
        for s in range(0, len(y), size):
            k, t = order[s : s + size], t + 1
            cols = np.concatenate([x[i] for i in k])
            row = np.repeat(np.arange(len(k)), [len(x[i]) for i in k])
            f = np.bincount(row, (r * w)[cols], len(k)) + b
            e = (weight[k] * (classify.sigmoid(f) - y[k]) / len(k)).astype(np.float32)
            g = np.append(r * np.bincount(cols, e[row], len(w)).astype(np.float32) + decay * w, e.sum()).astype(np.float32)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - float(step[-1])
    return w * r, b


def train(docs: DataFrame, labels: DataFrame, most_texts: int = MOST_TEXTS, errors: float = ERRORS, decay: float = DECAY) -> dict:
    """weights by bucket (float32, one for each of the 2**BITS buckets) and the intercept. Labels whose documents are absent count for nothing."""
    common.small_batches(docs.sparkSession)
    ids = classify.training_labels(labels, "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id")
    n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        return {"weights": np.zeros(1 << BITS, np.float32), "intercept": float(np.log((n_pos + 1) / (n_neg + 1)))}
    counts = class_counts(texts.select("text", "label")).toArrow()  # 2**BITS rows at most
    bucket, pos, neg = (counts.column(c).to_numpy() for c in ("bucket", "pos", "neg"))
    ratios = np.zeros(1 << BITS)
    ratios[bucket] = shrunk(log_count_ratios(pos, neg, n_pos, n_neg), pos, neg, errors)
    there = texts.select("doc_id", "label").distinct()
    some = [classify.hash_sample(there.where(F.col("label") == y), most_texts) for y in (0, 1)]
    x, y = _rows(classify.texts_of(docs, some[0].union(some[1])).repartition(8), ratios != 0)
    used = np.flatnonzero(ratios)
    w, b = fit([np.searchsorted(used, k) for k in x], y, ratios[used], n_pos / (n_pos + n_neg), decay=decay)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return {"weights": weights, "intercept": b}


def validation(doc_id: Column) -> Column:
    """True for the fifth of the ids that compared() keeps from its fits; no matter whether they are held out."""
    return F.coalesce(F.crc32(F.concat(F.lit("validation:"), doc_id.cast("string"))) % 5 == 0, F.lit(False))


def compared(docs: DataFrame, labels: DataFrame, settings: list[dict]) -> list[dict]:
    """For each of the settings (options of train()) how it does on training rows that it did not see: rows, right and mean log loss.

    Rows that are held out are neither learnt from nor looked at.
    """
    known = classify.training_labels(labels, "toxic")
    learnt = known.where(~validation(F.col("doc_id"))).withColumnRenamed("label", "toxic")
    rest = known.where(validation(F.col("doc_id"))).withColumnRenamed("doc_id", "id")
    rows = docs.join(rest, F.col("doc_id") == F.col("id"), "left_semi")
    out = []
    for options in settings:
        got = score_toxicity(rows, learnt, model=train(docs, learnt, **options)).join(rest, F.col("doc_id") == F.col("id"))
        p = F.least(F.greatest(F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score")), F.lit(1e-9)), F.lit(1.0))
        out.append(options | got.agg(F.count("*").alias("rows"), F.sum((F.col("predicted") == F.col("label")).cast("int")).alias("right"), F.avg(-F.log(p)).alias("loss")).first().asDict())
    return out


def scores(model: dict, texts: Iterator[str]) -> list[float]:
    weights, b = model["weights"], model["intercept"]
    used = weights != 0
    out = []
    for text in texts:
        k = buckets(text)
        k = np.unique(k[used[k]])  # a bucket counts once
        out.append(b + float(weights[k].sum(dtype=np.float64)))
    return classify.sigmoid(np.array(out, float))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model: dict | None = None, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is likelier toxic) and predicted (1 if score >= threshold) for every document.

    Only the text is an input of the score, and the whole of it. Null and empty
    texts get the score of a text without n-grams. Rows with a null doc_id are
    scored, never learnt from. Equal texts get equal scores. An empty table
    gives no rows; if one label is missing every score is the labels' smoothed
    share. Other columns are not read. The logistic fit has at most `most_texts`
    rows of either label; the ratios that scale its features are counted over
    all texts that may be learnt from. `model` is one that train() made already.
    """
    model = model or train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in textpack.slices(batch, "text"):
                out = pa.array(scores(shared.value, _texts(part.column("text"))), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), out], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, with the bounds of this module; as score_toxicity() says."""
    return score_toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

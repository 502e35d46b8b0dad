"""Quality by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, common, textpack

#: At most so many trusted positives are rows of the fit. Unlabelled text is not sampled: every sum over it takes all documents that are not held out.
MOST_POSITIVES = 6_000
#: Up to so many tasks hand their sums to the driver, a few KB each; those of more are added up by a shuffle first.
MOST_PARTS = 512
#: Hash buckets of words, whose shares are features too.
WORD_BUCKETS = 256
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": bytes(textpack.SPACES),
    "line": b"\n",
    "stop": b".,;:'\"()-?",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "high": bytes(range(128, 256)),
}
SURFACE = len(_CLASSES) + 6
_SHARES = np.zeros((len(_CLASSES), 256), bool)
for _row, _members in zip(_SHARES, _CLASSES.values(), strict=True):
    _row[list(_members)] = True


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row for each text: shares of kinds of bytes, size, length of words, repeated and distinct words, then the square root of each word bucket's share. All 0 for an empty text."""
    n = len(offs) - 1
    size = np.diff(offs)
    out = np.zeros((n, SURFACE + WORD_BUCKETS), np.float32)
    full = size > 0
    if not full.any():
        return out
    for k, members in enumerate(_SHARES):
        total = np.concatenate(([0], np.cumsum(members[buf], dtype=np.int64)))
        out[full, k] = (total[offs[1:]] - total[offs[:-1]])[full] / size[full]
    h, at = textpack.words(buf, offs)
    count = np.diff(at)
    some = count > 0
    words = np.maximum(count, 1)
    k = len(_CLASSES)
    out[:, k] = np.log1p(size) / 10
    out[some, k + 1] = np.minimum((size / words)[some], 50) / 10
    again = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        same = h[1:] == h[:-1]
        same[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(h))] - 1] = False
        np.cumsum(np.concatenate(([0], same)), out=again[1:])
    out[:, k + 2] = (again[at[1:]] - again[at[:-1]]) / words
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)])
    out[some, k + 3] = (distinct / words)[some]
    out[some, k + 4] = np.log1p(distinct[some]) / np.log1p(count[some])
    out[:, k + 5] = full
    bucket = np.repeat(np.arange(n), count) * WORD_BUCKETS + (h % np.uint64(WORD_BUCKETS)).astype(np.int64)
    many = np.bincount(bucket, minlength=n * WORD_BUCKETS).reshape(n, -1)
    out[:, SURFACE:] = np.sqrt(many / words[:, None])
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Square roots beside the surface features, since small shares count too, and a constant."""
    return np.hstack([x, np.sqrt(np.maximum(x[:, :SURFACE], 0)), np.ones((len(x), 1), np.float32)])


class Rows:
    """Unlabelled rows in memory. total() adds up what a function gives for them, in slices."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def total(self, add) -> np.ndarray:
        return np.sum([add(self.x[i : i + 4096]) for i in range(0, max(1, len(self.x)), 4096)], axis=0)


class Table(Rows):
    """Unlabelled rows as a table of features, a few hundred numbers for each text. total() adds up in each task before anything leaves it."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def total(self, add) -> np.ndarray:
        width = SURFACE + WORD_BUCKETS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                total = total + add(expand(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f4").reshape(-1, width)))
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

        sums = self.rows.select("x").mapInArrow(run, "sums array<double>")
        if self.rows.rdd.getNumPartitions() <= MOST_PARTS:
            parts = [np.array(r["sums"]) for r in sums.collect()]
            return np.array([math.fsum(c) for c in np.array(parts).T]) if parts else add(np.zeros((0, SURFACE * 2 + WORD_BUCKETS + 1), np.float32))
        each = sums.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,12)")).cast("double").alias("v"))
        return np.array([r["v"] for r in sorted(each.collect(), key=lambda r: r["at"])])


def moments(unlabelled: Rows, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation (and a little) of each feature over all rows of either kind; the constant is left as it is."""
    add = lambda x: np.concatenate(([len(x)], x.sum(0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(0)))
    total = unlabelled.total(add) + add(pos)
    n, d = max(1.0, total[0]), pos.shape[1]
    centre = total[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(total[1 + d :] / n - centre**2, 0)) + 1e-3
    centre[-1], scale[-1] = 0, 1
    return centre.astype(np.float32), scale.astype(np.float32)


def unlabelled_terms(unlabelled: Rows, w: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss of the unlabelled rows as negatives, and its gradient."""

    def add(x: np.ndarray) -> np.ndarray:
        x = (x - centre) / scale
        f = x @ w
        return np.concatenate(([len(x), np.logaddexp(0, f).sum()], classify.sigmoid(f) @ x))

    total = unlabelled.total(add)
    n = max(1.0, total[0])
    return total[1] / n, total[2:] / n


def contrast(p: np.ndarray, w: np.ndarray, loss: float, grad: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray | None]:
    """Risk and gradient of positives against unlabelled rows."""
    f = p @ w
    return np.logaddexp(0, -f).mean() + loss, 0.0, grad - (1 - classify.sigmoid(f)) @ p / len(p), None


def non_negative(prior: float):
    def risk(p: np.ndarray, w: np.ndarray, loss: float, grad: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray | None]:
        """The non-negative risk and its gradient; where the second term is negative, that term and its gradient too."""
        f = p @ w
        s = classify.sigmoid(f)
        second, ahead = loss - prior * np.logaddexp(0, f).mean(), grad - prior * (s @ p) / len(p)
        first, back = prior * np.logaddexp(0, -f).mean(), -prior * ((1 - s) @ p) / len(p)
        return (first + second, 0.0, back + ahead, None) if second >= 0 else (first, second, back, ahead)

    return risk


def minimise(unlabelled: Rows, p: np.ndarray, centre: np.ndarray, scale: np.ndarray, risk, rounds: int, decay: float = 1e-3, memory: int = 10) -> np.ndarray:
    """Weights by a limited-memory quasi-Newton method, from zero; each of `rounds` looks at all unlabelled rows once.

    Where the risk's second term, which no real risk can make negative, is
    negative, the step ascends on that term alone until it would be 0, and what
    was learnt of the curvature is forgotten.
    """
    w, pairs, last, step = np.zeros(p.shape[1]), [], None, 1.0
    for _ in range(rounds):
        value, second, g, ahead = risk(p, w, *unlabelled_terms(unlabelled, w, centre, scale))
        value, g = value + decay / 2 * (w @ w), g + decay * w
        if ahead is not None and ahead @ ahead > 1e-18:
            w, pairs, last, step = w + min(1.0, -second / (ahead @ ahead)) * ahead, [], None, 1.0
            continue
        if last is not None and value > last[1] + 1e-4 * step * (last[2] @ last[3]):
            step /= 4  # too far: back to a part of the way
            w = last[0] + step * last[3]
            continue
        if last is not None:
            s, y = w - last[0], g - last[2]
            if s @ y > 1e-12:
                pairs = [*pairs, (s, y)][-memory:]
        q, held = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            held.append(a)
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.sqrt(g @ g))
        for (s, y), a in zip(pairs, reversed(held), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        last, step = (w, value, g, -q), 1.0
        w = w - q
    return last[0] if last is not None else w


def best_bin(cuts: np.ndarray, above_p: np.ndarray, n_p: int, above_u: np.ndarray, n_u: int, delta: float = 0.1) -> float:
    """The positives' share of the unlabelled rows, from the rows of either kind whose score is at least each cut.

    Positives above a cut are no more than the unlabelled rows above it, so
    (unlabelled share above) / (positive share above) bounds the share from
    above; the cut with the least upper confidence bound gives the estimate.
    """
    if not n_p or not n_u:
        return 0.5
    qp, qu = above_p / n_p, above_u / n_u
    slack = np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p)
    best = np.argmin((qu + slack) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.02, 0.98))


def _cuts(scores_p: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(scores_p, np.linspace(0, 0.98, 200)))


def estimate_prior(pos: np.ndarray, learnt: Rows, counted: Rows, rounds: int = 20) -> float:
    """best_bin() of two halves: a classifier learns from one half of the positives and the rows of `learnt`, the others are counted."""
    if len(pos) < 2:
        return 0.5
    centre, scale = moments(learnt, pos[::2])
    p = (pos - centre) / scale
    w = minimise(learnt, p[::2], centre, scale, contrast, rounds)
    p = p[1::2] @ w
    cuts = _cuts(p)

    def add(x: np.ndarray) -> np.ndarray:
        score = (x - centre) / scale @ w
        return np.append((score[:, None] >= cuts).sum(0), len(x)).astype(np.float64)

    total = counted.total(add)
    return best_bin(cuts, (p[:, None] >= cuts).sum(0), len(p), total[:-1], int(total[-1]))


def fit(pos: np.ndarray, unlabelled: Rows, prior: float, rounds: int = 30) -> dict:
    """Minimise  prior * R+(positives)  +  max(0, R-(unlabelled) - prior * R-(positives))  of the logistic loss. Without positives every score is one half."""
    if not len(pos):
        d = SURFACE * 2 + WORD_BUCKETS + 1
        return {"w": np.zeros(d), "centre": np.zeros(d, np.float32), "scale": np.ones(d, np.float32), "prior": 0.5}
    centre, scale = moments(unlabelled, pos)
    w = minimise(unlabelled, (pos - centre) / scale, centre, scale, non_negative(prior), rounds)
    return {"w": w, "centre": centre, "scale": scale, "prior": prior}


def scores(model: dict, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return classify.sigmoid((expand(features(buf, offs)) - model["centre"]) / model["scale"] @ model["w"])


def _features(texts: DataFrame, *keep: str) -> DataFrame:
    """x, the features of each text as bytes, beside the columns `keep`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in textpack.slices(batch, "text"):
                x = features(buf, offs).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *(part.column(c) for c in keep)], names=["x", *keep])

    kinds = dict(texts.dtypes)
    rows = texts.select(F.col("text").cast("binary").alias("text"), *keep)
    return rows.mapInArrow(run, ", ".join(["x binary", *(f"{c} {kinds[c]}" for c in keep)]))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, most_positives: int = MOST_POSITIVES) -> dict:
    """Trusted positives: a bounded sample of the training rows with quality 1. Unlabelled: all documents that are not held out, labels unseen, so that some are positives too.

    Their features are written once; every step of the fit adds up the
    unlabelled risk and its gradient over all of them, in the tasks that read
    them. The class prior comes from one half of them, scored by a classifier
    that learns from the other half.
    """
    common.small_batches(docs.sparkSession)
    positives = classify.hash_sample(classify.training_labels(labels, "quality").where("label = 1").join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), most_positives)
    raw = sorted(bytes(r["x"]) for r in _features(classify.texts_of(docs, positives)).collect())  # about 1 KB a text; the order that rows arrive in shall not matter
    if not raw:
        return fit(np.zeros((0, 1)), Rows(np.zeros((0, 1))), 0.5)
    pos = expand(np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), -1))
    pos = np.random.Generator(np.random.PCG64(7)).permutation(pos)
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)).cast("int")
    open_ = docs.where(F.col("doc_id").isNotNull() & ~common.held_out("doc_id")).select("text", half.alias("half"))
    table = common.written(_features(open_, "half"), "features")
    if prior is None:
        prior = estimate_prior(pos, Table(table.where("half = 0")), Table(table.where("half = 1")))
    return fit(pos, Table(table), prior)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better) and predicted (1 if score >= threshold) for every document.

    Only the text is an input of the score. Null texts count as empty; empty
    texts get the model's score for all-zero features. Rows with a null doc_id
    are scored, never learnt from. Equal texts get equal scores. An empty
    table gives no rows; without usable labels every score is one half. Other
    columns are not read. At most `most_positives` labelled texts are rows of the
    fit; the unlabelled sums take every document that is not held out.
    """
    model = train(docs, labels, **options)
    return classify.scored(docs, lambda buf, offs: scores(model, buf, offs), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold; filtered where they are read, without a shuffle. Rows are scored as by score_quality()."""
    model = train(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in textpack.slices(batch, "text"):
                yield part.filter(pa.array(scores(model, buf, offs) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, with the bounds of this module; as score_quality() says."""
    return score_quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

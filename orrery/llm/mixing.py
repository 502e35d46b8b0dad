"""Mixing to target weights: token weights raked to source, language and topic marginals, then a calibrated sample."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: No more cells than this are raked; it bounds what the driver holds.
MOST_CELLS = 1_000_000
#: Raking ends when every share is so near its target; a share further off than MISSED is reported.
SETTLED, MISSED = 1e-15, 1e-6

Targets = Mapping[str, Mapping[str, float]]


def n_tokens(text: Column | str) -> Column:
    """Words of a text: runs of bytes other than space and tab to carriage return; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(text, F.lit(""))
    edges = F.substring(text, 1, 1).rlike(r"^[ \t-\r]$").cast("int") + F.substring(text, -1, 1).rlike(r"^[ \t-\r]$").cast("int")
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"[ \t-\r]+")) - edges).cast("long")


def length_topic(tokens: Column) -> Column:
    """The documents carry no topic; their length class stands for it: short (under 128 words), medium (under 512) or long."""
    return F.when(tokens < 128, "short").when(tokens < 512, "medium").otherwise("long")


def rake(cells: np.ndarray, mass: np.ndarray, targets: list[np.ndarray], rounds: int = 25) -> tuple[np.ndarray, float]:
    """Factors of the cells (rows of category numbers, one column a margin) that bring the mass of every margin to its target, and how far off a category's share still is at most.

    Iterative proportional fitting: each round scales every margin in turn,
    until all are met to SETTLED or the rounds are over. A category without
    mass cannot be met; its share goes to the others.
    """
    factor = np.ones(len(mass))
    goals = []
    for k, target in enumerate(targets):
        there = np.bincount(cells[:, k], mass, len(target)) > 0
        goal = np.where(there, target, 0)
        goals.append(goal / goal.sum() if goal.sum() else goal)
    off = 0.0
    for _ in range(rounds):
        for k, goal in enumerate(goals):
            now = np.bincount(cells[:, k], mass * factor, len(goal))
            factor = factor * np.divide(goal * mass.sum(), now, out=np.zeros(len(goal)), where=now > 0)[cells[:, k]]
        shares = [np.bincount(cells[:, k], mass * factor, len(goal)) / (mass.sum() or 1) for k, goal in enumerate(goals)]
        off = max((float(np.abs(share - goal).max()) for share, goal in zip(shares, goals, strict=True)), default=0.0)
        if off < SETTLED:
            break
    return factor, off


def mix(docs: DataFrame, margins: Mapping[str, Column], targets: Targets, tokens: Column, rounds: int = 25, budget: float | None = None, seed: int = 3, keep: float | None = None, others: bool = False, strict: bool = False) -> DataFrame:
    """docs with n_tokens, weight, probability and sampled (and a column for each margin, named as in `margins`).

    weight scales a document's tokens so that each margin's weighted share
    meets its target. probability is the weight times one constant, capped at
    1: by default the largest constant that needs no cap, so that the expected
    sample meets every margin exactly; with `budget`, expected tokens of the
    sample, the constant is solved for with the caps in force; `keep` gives the
    budget as a share of the cells' tokens. sampled compares
    the probability with a hash of (seed, doc_id), so a document's fate depends
    on no other row's order.

    Only the cells' token sums reach the driver. Their number is at most the
    product of the given targets' sizes, checked against MOST_CELLS. Rows whose
    category is null or has no target get weight 0 and are never sampled; with
    `others` they are one more category of that margin, whose target is the
    share of the tokens that it has, and the given targets share the rest. Texts
    without words carry no mass; they share their cell's weight. Equal doc_ids
    share their fate. Columns of the new names are replaced, all others stay.
    An empty table gives no rows. Targets that contradict each other on these
    cells, so that a share is off by more than MISSED after all rounds, give a
    warning that says by how much, with `strict` a ValueError.
    """
    names = list(margins)
    if np.prod([float(len(targets[m]) + others) for m in names]) > MOST_CELLS:
        raise ValueError("too many cells; coarsen a margin")
    index = {m: {c: i for i, c in enumerate(sorted(targets[m]))} for m in names}
    category = {m: F.when(F.col(m).isin(*index[m]), F.col(m)) if others else F.col(m) for m in names}
    keys = dict(zip(names, common.free_names([*docs.columns, *names], *names), strict=True))
    docs = docs.drop("weight", "probability", "sampled")
    rows = docs.withColumns({**margins, "n_tokens": tokens})
    wanted = rows.select(*(category[m].alias(m) for m in names), "n_tokens")
    for m in names:
        if others:
            index[m][None] = len(index[m])
        else:
            wanted = wanted.where(F.col(m).isin(*index[m]))
    sums = wanted.groupBy(*names).agg(F.sum("n_tokens").cast("double").alias("mass")).orderBy(*names).collect()
    cells = np.array([[index[m][r[m]] for m in names] for r in sums], np.int64).reshape(-1, len(names))
    mass = np.array([r["mass"] or 0.0 for r in sums])
    goals = [np.array([float(targets[m][c]) for c in sorted(targets[m])]) for m in names]
    if others:
        own = [mass[cells[:, k] == len(goal)].sum() / (mass.sum() or 1) for k, goal in enumerate(goals)]
        goals = [np.append(goal * (1 - x) / (goal.sum() or 1), x) for goal, x in zip(goals, own, strict=True)]
    factor, off = rake(cells, mass, goals, rounds) if len(mass) else (np.zeros(0), 0.0)
    if off > MISSED:
        if strict:
            raise ValueError(f"targets cannot be met together: a share is off by {off:.2g} after {rounds} rounds")
        warnings.warn(f"a share is off its target by {off:.2g} after {rounds} rounds", stacklevel=2)
    budget = keep * mass.sum() if keep is not None else budget
    top = factor[mass > 0].max(initial=0.0)
    scale = 1 / top if top else 0.0
    if budget is not None and top:
        order = np.argsort(-factor, kind="stable")
        f, w = factor[order], mass[order]
        for i in range(len(f)):  # the first i cells are capped
            rest = (f[i:] * w[i:]).sum()
            scale = (budget - w[:i].sum()) / rest if rest > 0 else scale
            if scale * f[i] <= 1:
                break
        scale = max(scale, 0.0)
    table = [(*(r[m] for m in names), float(x), float(min(1.0, x * scale))) for r, x in zip(sums, factor, strict=True)]
    fields = [T.StructField(keys[m], T.StringType()) for m in names]
    schema = T.StructType([*fields, T.StructField("weight", T.DoubleType()), T.StructField("probability", T.DoubleType())])
    weights = docs.sparkSession.createDataFrame(table, schema)
    joined = rows.join(F.broadcast(weights), [category[m].eqNullSafe(F.col(keys[m])) if others else F.col(m) == F.col(keys[m]) for m in names], "left").drop(*keys.values())  # MOST_CELLS rows at most
    joined = joined.fillna(0.0, ["weight", "probability"])
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return joined.withColumn("sampled", draw < F.col("probability"))


#: What the corpus is mixed to.
SOURCES = {f"src{i}": 0.05 for i in range(20)}
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
TOPICS = {"short": 0.1, "medium": 0.4, "long": 0.5}
TARGETS: Targets = {"source": SOURCES, "lang": LANGUAGES, "topic": TOPICS}
ROUNDS = 25


def mixed_documents(docs: DataFrame, keep: float | None = None, others: bool = False, targets: Targets = TARGETS, tokens: Column | None = None, strict: bool = False) -> DataFrame:
    """mix() of documents by source, lang and length class (column topic), to `targets`; tokens, if given, are counted already.

    Nulls, empty and long texts, ties, repeated rows, empty tables and other columns are treated as mix() says.
    """
    n, topic = common.free_names([*docs.columns, "source", "lang", "topic"], "words", "class")
    rows = docs.withColumn(n, n_tokens("text") if tokens is None else tokens).withColumn(topic, length_topic(F.col(n)))
    out = mix(rows, {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(topic)}, targets, F.col(n), ROUNDS, keep=keep, others=others, strict=strict)
    return out.drop(n, topic)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and the sample of all documents; as mixed_documents() says."""
    rows = common.documents(spark, sf_dir).select("doc_id", "source", "lang", n_tokens("text").alias("words"))
    out = mixed_documents(common.written(rows, "tokens"), tokens=F.col("words"))  # words are counted once
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 8).alias("weight"), F.round("probability", 8).alias("probability"), "sampled")


def op1_sql() -> str:
    """The same by unrolled common table expressions: a factor column rescaled for each margin of each round."""
    values = lambda d: ", ".join(f"('{k}', {v!r})" for k, v in d.items())
    steps, last = [], "f0"
    for r in range(ROUNDS):
        for m in TARGETS:
            new = f"f{r}_{m}"
            steps.append(f"""{new} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.mass, c.f * coalesce(g.goal * t.total / nullif(s.now, 0), 0) AS f
 FROM {last} c JOIN (SELECT {m}, sum(mass * f) AS now FROM {last} GROUP BY 1) s USING ({m}) JOIN goal_{m} g USING ({m}), total t)""")
            last = new
    goals = [
        f"""goal_{m} AS (SELECT {m}, CASE WHEN there THEN w / sum(CASE WHEN there THEN w ELSE 0 END) OVER () ELSE 0 END AS goal
 FROM (SELECT t.{m}, t.w, coalesce(s.x, 0) > 0 AS there FROM (VALUES {values(d)}) t({m}, w) LEFT JOIN (SELECT {m}, sum(mass) AS x FROM f0 GROUP BY 1) s USING ({m})))"""
        for m, d in TARGETS.items()
    ]
    inside = " AND ".join(f"{m} IN ({', '.join(repr(k) for k in d)})" for m, d in TARGETS.items())
    return f"""WITH counted AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
d AS (SELECT *, CASE WHEN n_tokens < 128 THEN 'short' WHEN n_tokens < 512 THEN 'medium' ELSE 'long' END AS topic FROM counted),
f0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass, CAST(1 AS DOUBLE) AS f FROM d WHERE {inside} GROUP BY 1, 2, 3),
total AS (SELECT sum(mass) AS total FROM f0),
{', '.join(goals)},
{', '.join(steps)},
w AS (SELECT source, lang, topic, f, f / max(CASE WHEN mass > 0 THEN f END) OVER () AS p FROM {last}),
j AS (SELECT d.*, coalesce(f, 0) AS weight, least(1, coalesce(p, 0)) AS probability FROM d LEFT JOIN w USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 8) AS weight, round(probability, 8) AS probability,
 CAST('0x' || substr(md5('3:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) / 4294967296.0 < probability AS sampled FROM j"""

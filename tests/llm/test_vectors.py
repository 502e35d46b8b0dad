"""Searches and codes of integer vectors against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import lloyd, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"
#: Columns whose names the operators use themselves.
CLASH = ("query_id", "rank", "score", "ints", "q", "many", "floor", "code", "upper", "lower", "error", "salt", "label_", "salt_", "b", "w")


def table(spark, dim=32, many=150, seed=3):
    """Vectors in clusters with copies, ties, nulls, odd lengths, null and repeated ids."""
    rnd = random.Random(seed)
    point = lambda: [rnd.gauss(0, 0.2) for _ in range(dim)]
    centres = [point() for _ in range(6)]
    rows = [(i, [float(np.float32(c + rnd.gauss(0, 0.05))) for c in rnd.choice(centres)], i % 4) for i in range(many)]
    rows += [(many + i, rows[7][1], 9) for i in range(20)] + [(300, rows[1][1], None), (350, rows[2][1], None), (350, rows[2][1], 1), (350, rows[5][1], 1)]
    rows += [(None, rows[3][1], 1), (None, rows[3][1], 2), (400, None, 1), (450, [*rows[0][1][:-1], None], 1), (500, [math.nan, *rows[0][1][1:]], 1), (550, [math.inf] * dim, 1)]
    rows += [(600, [], 1), (601, [], 2), (650, [0.5, -0.5], 1), (651, [0.25, 1.5], 1), (700, [0.0] * dim, None), (750, [900.0] * dim, 3), (800, [3e38] + [-3e38] * (dim - 1), 3)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(c) for c in CLASH}), rows


def whole(rows):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [max(-vectors.LIMIT, min(vectors.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v], label))
    return out


def best(rows, k):
    out = []
    for n, (i, v, _) in enumerate(rows):
        if i is not None and i % 50 == 0:
            others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, j) for m, (j, w, _) in enumerate(rows) if len(w) == len(v) and (j is None or j != i)]
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(others)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 5])
def test_top_k(spark, k):
    df, rows = table(spark)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(whole(rows), k)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).isEmpty()
    assert topk.top_k(df.where("vec_id = 7"), F.lit(True)).isEmpty()


def test_top_k_in_many_batches(spark, monkeypatch):
    df, rows = table(spark, 16, 120, 8)
    monkeypatch.setattr(topk, "BATCH", 1500)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(whole(rows), 5)


@pytest.mark.parametrize(("dim", "scale"), [(1, 3), (8, 5), (19, 300), (64, 300), (40, 1 << 26)])
def test_bounds_lose_no_pair(dim, scale):
    rng = np.random.default_rng(dim)
    x = rng.integers(-scale, scale + 1, (700, dim))
    x[100:200] = x[3]  # many ties
    q, own = x[:300], np.arange(300)
    c = topk.Candidates(topk._chunk([(i if i % 90 else None, v.astype("<i4").tobytes()) for i, v in enumerate(x)]))
    exact = q @ x.T
    for rank in (3, 40):
        floor = np.sort(exact, 1)[:, -rank].astype(float)
        i, j, score = topk.search(q, own, floor, c)
        assert (exact[i, j] == score).all()
        want = {(a, b) for a, b in zip(*np.nonzero(exact >= floor[:, None]), strict=True) if a != b or b % 90 == 0}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_long_sums_stay_exact():
    x = np.full((2, 512), 1 << 26)
    x[1, 0] -= 1
    c = topk.Candidates(topk._chunk([(i, v.astype("<i4").tobytes()) for i, v in enumerate(x)]))
    i, j, score = topk.search(x, np.array([5, 6]), np.full(2, -np.inf), c)
    want = {(a, b): sum(int(p) * int(r) for p, r in zip(x[a], x[b], strict=True)) for a in range(2) for b in range(2)}
    assert {(a, b): s for a, b, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True)} == want


def codes(rows, parts=16, entries=64, rounds=2):
    """Plain Lloyd rounds in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    dim = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == dim]
    width = -(-dim // parts)
    piece = lambda v, p: v[p * width : (p + 1) * width]
    books = [[piece(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda a, book: min(range(len(book)), key=lambda e: (d(a, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in rows:
                own[nearest(piece(v, p), books[p])].append(piece(v, p))
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)]
    out, sums = [], {}
    for i, v, label in rows:
        code = [nearest(piece(v, p), books[p]) for p in range(parts)]
        error = sum(d(piece(v, p), books[p][c]) for p, c in enumerate(code))
        out.append((i, "".join(f"{c:02x}" for c in code), error, label))
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(sums[label], (1 << 63) - 1), digest) for i, c, e, label in out), key=str)


@pytest.mark.parametrize(("dim", "few"), [(32, 10**6), (20, 2), (5, 10**6)])
def test_codes(spark, monkeypatch, dim, few):
    monkeypatch.setattr(lloyd, "FEW", few)
    df, rows = table(spark, dim, 150, dim)
    got = lloyd.compress(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes(whole(rows))
    assert lloyd.compress(df.where("embedding is null")).isEmpty()


def test_codes_of_few_rows(spark):
    for rows in ([(3, [0.5] * 16, None)], [(None, [], 1), (2, [], None)], [(2, [1.0] * 8, 1)] * 70 + [(1, [-1.0] * 8, 2)]):
        got = lloyd.compress(spark.createDataFrame(rows, SCHEMA))
        assert sorted((tuple(r) for r in got.collect()), key=str) == codes(whole(rows))


@pytest.mark.parametrize("scale", [3, 300, 1 << 26])
def test_bounds_keep_assignments_right(scale):
    """Whatever way the entries move, the bounds never keep an entry that a full scan would not give, and spare scans."""
    rng = np.random.default_rng(scale)
    x, spared = rng.integers(-scale, scale + 1, (2000, 4)), 0
    entries = x[None, :64].copy()
    code, upper, lower = lloyd.scan(x, entries[0])
    for step in range(8):
        new = entries + rng.integers(-max(1, scale // 60), max(1, scale // 60) + 1, entries.shape) * (step % 4 != 3)
        code, upper, lower, scans = lloyd.reassign(x, lloyd.Book(new, entries), 0, code, upper, lower)
        entries = new
        d = ((x[:, None, :].astype(object) - entries[0][None].astype(object)) ** 2).sum(2)
        assert code.tolist() == [min(range(64), key=lambda e, r=r: (r[e], e)) for r in d.tolist()]
        spared += len(x) - scans
    assert spared > 2000 or scale == 3

"""Merkle manifests against a tree built in plain Python."""

import random
import sys
import zlib
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from orrery.llm import merkle  # noqa: E402

CLASH = ("tree", "value", "altered", "many", "copy", "task", "level", "at", "leaf", "root", "of", "path", "origin", "first", "n", "rows", "start")
H = lambda *x: sha256("".join(x).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes):
    """(root, the proof of each node as a list of (side, sibling))"""
    proofs, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, kept = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for k, own in enumerate(held[i : i + 2]):
                for x in own:
                    proofs[x].append((None, "") if len(run) == 1 else ("L", run[0]) if k else ("R", run[1]))
            up.append(H(*run))
            kept.append(sum(held[i : i + 2], []))
        nodes, held = up, kept
    return nodes[0], proofs


def manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    parts, subroots = [], []
    for x in langs:
        own = sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        root, proofs = tree([leaf(*r) for r in own])
        subroots.append(root)
        parts.append((own, proofs))
    root, above = tree(subroots)
    out = []
    for (own, proofs), subroot, more in zip(parts, subroots, above, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                now = (*r[:4], r[4] + 1)
            folded = leaf(*now)
            for side, sibling in proof + more:
                folded = H(sibling, folded) if side == "L" else H(folded, sibling)
            out.append((r[0], leaf(*r), subroot, root, H(*(s for _, s in proof + more)), folded, folded == root))
    return sorted(out, key=str)


def table():
    rnd = random.Random(4)
    rows = [(i * 3, t, ["en", "é", "", None, "de"][min(4, i % 7)], None if i % 11 == 5 else "src", None if i % 13 == 2 else len(t or "")) for i, t in enumerate(cases.texts(2, 40))]
    rows += [(rnd.choice([None, 5, (1 << 63) - 1, -(1 << 63)]), "x", rnd.choice(["en", "de"]), "s", (1 << 63) - 1) for _ in range(30)]
    return rows + [rows[-1]] * 25 + [(77, "alone", "fr", None, 5)]


@pytest.mark.parametrize(("size", "crown"), [(9, 4), (30, 20), (60, 1000), (10_000, 10_000)])
def test_manifest(spark, monkeypatch, size, crown):
    """One task or many, with frontiers that meet in several rounds, and a crown of its own."""
    monkeypatch.setattr(merkle, "ROWS", size)
    monkeypatch.setattr(merkle, "CROWN", crown)
    rows = table()
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(4).withColumns({c: F.lit(c) for c in CLASH})
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()
    assert sorted((tuple(r) for r in got), key=str) == manifest(rows)


def test_small_manifests(spark):
    for rows in ([(1, None, None, None, None)], [(0, "a", "en", "s", 1), (2, "", "de", "s", 0)]):
        got = merkle.manifest(spark.createDataFrame(rows, cases.SCHEMA), F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()
        assert sorted((tuple(r) for r in got), key=str) == manifest(rows)
    assert merkle.manifest(cases.empty(spark)).isEmpty()
    whole = merkle.manifest(spark.createDataFrame(table(), cases.SCHEMA))
    assert whole.where("not verified").isEmpty()


def test_ancestors_come_as_children_do():
    """Digests in any order give the same nodes; a parent of the size-derived arity is made at once."""
    for n in (1, 2, 3, 5, 11, 16):
        leaves = [H(str(i)) for i in range(n)]
        root, proofs = tree(leaves)
        order = list(range(n))
        random.Random(n).shuffle(order)
        grown = merkle.Growth(n)
        for i in order:
            grown.add(0, i, leaves[i])
        assert list(grown.frontier()) == [((n - 1).bit_length(), 0, root)]
        found = merkle.Proofs(grown, {((n - 1).bit_length(), 0): ()})
        for i in range(n):
            assert merkle.fold(leaves[i], found(0, i)) == (root, H(*(s for _, s in proofs[i])))
            assert merkle.unpack(merkle.pack(found(0, i))) == found(0, i)

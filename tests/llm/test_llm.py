"""Operators of the training-data subpackage against brute force, SQL, exact round trips or held-out labels."""

import hashlib
import math
import random
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from orrery.llm import bpe, common, jaccard, lattice, lmscore, mixing, quality, queries, repeats, sharding, toxicity, winnow  # noqa: E402

DATA = "/root/testdata/sf0.01"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (100, 7), (200, 201), (300, 300), (None, 1)]
    got = dict(rows(common.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    want = cases.components({x for e in edges[:-2] for x in e}, edges[:-2])
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_mixing_margins(spark):
    rnd = random.Random(2)
    docs = cases.documents(spark, [" ".join("w" * rnd.randint(1, 900)) for _ in range(400)])
    got = mixing.mixed_documents(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled", "shard").collect()
    assert len(got) == 400
    inside = [r for r in got if r["weight"] > 0]
    total = sum(r["n_tokens"] * r["weight"] for r in inside)
    for name, want in (("lang", mixing.LANGUAGES), ("topic", mixing.TOPICS)):
        for c, share in want.items():
            assert sum(r["n_tokens"] * r["weight"] for r in inside if r[name] == c) / total == pytest.approx(share, abs=1e-6)
    assert all(0 <= r["probability"] <= 1 for r in got)
    assert not any(r["sampled"] for r in got if r["lang"] is None or r["source"] is None)
    assert mixing.mixed_documents(cases.empty(spark)).isEmpty()


def test_mixing_budget(spark):
    docs = spark.createDataFrame([(i, "en" if i % 4 else "de", "w " * 10) for i in range(400)], "doc_id long, lang string, text string")
    out = mixing.mix(docs, {"lang": F.col("lang")}, {"lang": {"en": 0.5, "de": 0.5}}, mixing.n_tokens("text"), budget=1500.0)
    p = {r["lang"]: r["probability"] for r in out.select("lang", "probability").distinct().collect()}
    assert 3000 * p["en"] + 1000 * p["de"] == pytest.approx(1500)
    words = spark.createDataFrame([(" a  b\n",), ("",), (None,), ("\t",), ("x",), ("a b c",)], "t string").select(mixing.n_tokens("t")).collect()
    assert [r[0] for r in words] == [2, 0, 0, 0, 1, 2]


def test_targets_that_contradict(spark):
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de", "a" if i % 2 else "b", "w " * 10) for i in range(40)], "doc_id long, lang string, source string, text string")
    margins, targets = {"lang": F.col("lang"), "source": F.col("source")}, {"lang": {"en": 0.5, "de": 0.5}, "source": {"a": 0.9, "b": 0.1}}
    with pytest.raises(ValueError, match="off by"):
        mixing.mix(docs, margins, targets, mixing.n_tokens("text"), strict=True)
    with pytest.warns(UserWarning, match="off its target"):
        mixing.mix(docs, margins, targets, mixing.n_tokens("text"))


def test_columns_with_the_names_of_helpers(spark):
    docs = cases.documents(spark, cases.texts(9, 10))
    out = mixing.mixed_documents(docs).select("doc_id", "text", "n_tokens", "__tokens", "__lang").collect()
    assert all((r["n_tokens"], r["__tokens"], r["__lang"]) == (len(cases.WORDS.findall(r["text"] or "")), "14", "15") for r in out)
    cut = sharding.interleave(docs, 4, F.col("source"), F.md5(F.col("doc_id").cast("string")))
    assert {(r["s"], r["__s"], r["_s"], r["__k"]) for r in cut.collect()} == {("22", "16", "21", "17")}
    left = repeats.cleaned_documents(docs)
    assert left.columns == docs.columns and {(r["did"], r["_did"], r["cls"], r["__did"]) for r in left.collect()} == {("10", "20", "9", "18")}


def test_mixing_stage_keeps_most_of_every_category(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    kinds = [("src1", "en"), ("src2", "de"), (None, "en"), ("src3", None), ("elsewhere", "fr"), ("src1", "xx")]
    data = [(i, "w " * rnd.choice([20, 200, 200, 900]), kinds[i % 6][1], kinds[i % 6][0], None) for i in range(1200)]
    docs = spark.createDataFrame(data, cases.SCHEMA)
    kept = corpus_pipeline.mixing_stage(spark, docs, DATA)
    assert kept.columns == docs.columns
    got = kept.collect()
    total = sum(len(r[1]) for r in data)
    assert sum(len(r["text"]) for r in got) / total == pytest.approx(corpus_pipeline.KEPT, abs=0.05)
    assert {(r["source"], r["lang"]) for r in got} == set(kinds)
    rest = mixing.mix(docs, {"source": F.col("source")}, {"source": {"src1": 0.5, "src2": 0.5}}, mixing.n_tokens("text"), others=True)
    sums = rest.groupBy("source").agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("weight")))
    now, then = zip(*((Counter({r[0]: r[1]}), Counter({r[0]: r[2]})) for r in sums.collect()), strict=True)
    now, then = sum(now, Counter()), sum(then, Counter())
    assert all(then[s] == pytest.approx(now[s]) for s in (None, "src3", "elsewhere")) and then["src1"] == pytest.approx(then["src2"])
    assert corpus_pipeline.mixing_stage(spark, cases.empty(spark), DATA).isEmpty()


@pytest.mark.parametrize("shards", [1, 8])
def test_sharding(spark, shards):
    docs = cases.documents(spark)
    docs = docs.union(docs.limit(5))
    n = docs.count()
    out = sharding.interleave(docs, shards, F.col("source"), F.md5(F.col("doc_id").cast("string")), rows_per_bucket=3).select("doc_id", "source", "shard", "slot").collect()
    assert len(out) == n
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    strata = Counter(r["source"] for r in out)
    for source, total in strata.items():  # what the other strata round to shifts the cuts
        each = Counter(r["shard"] for r in out if r["source"] == source)
        assert all(abs(each[s] - total / shards) <= 1 + len(strata) ** 0.5 for s in range(shards))
    assert sharding.interleave(cases.empty(spark), shards, F.col("source"), F.col("lang")).isEmpty()


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    reference, vocabulary = tokenizers.Tokenizer.from_file(path), bpe.load_vocabulary(path)
    rnd = random.Random(4)
    odd = ["<|endoftext|>", "\x1c", "\u0085", "​", "'re", "²", "  ", "\r\n", "é", "é", "\U0001e030", "a", "!", "1"]
    texts = cases.texts() + ["".join(rnd.choice(odd) for _ in range(30)) for _ in range(100)] + ["z" * 5000]
    coded = bpe.decode(bpe.encode(cases.documents(spark, texts), vocabulary), vocabulary).select("text", "ids", "decoded", "shard").collect()
    assert len(coded) == len(texts)
    for r in coded:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    both = bpe.encode_and_decode(cases.documents(spark, texts), vocabulary).select("text", "ids", "decoded", "shard").collect()
    assert sorted(both, key=repr) == sorted(coded, key=repr)
    assert bpe.digests(cases.empty(spark)).isEmpty()


def test_a_worker_keeps_one_encoder():
    class Shared:
        def __init__(self, number):
            self.id, self.value = number, number

    made = [bpe._once("encode-test", Shared(i), lambda v: [v]) for i in (-1, -2, -2)]
    assert made == [[-1], [-2], [-2]] and made[1] is made[2] and bpe._ready["encode-test"] == (-2, [-2])
    del bpe._ready["encode-test"]


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    import json

    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="plain byte-level"):
            bpe.load_vocabulary(str(path))


@pytest.mark.parametrize("score, target", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_held_out_accuracy(spark, score, target):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = score(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", target).collect()
    assert np.mean([a == b for a, b in got]) > 0.9


@pytest.mark.parametrize("score, target", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_classifiers_on_odd_tables(spark, score, target):
    docs = cases.documents(spark)
    none = spark.createDataFrame([], f"doc_id long, {target} int")
    n = docs.count()
    assert score(docs, none).where("score between 0 and 1").count() == n
    some = docs.select("doc_id", F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 2).cast("int")).alias(target))
    got = score(docs.union(docs.where("doc_id = 3")), some.union(some)).collect()
    assert len(got) == n + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert score(cases.empty(spark), some).isEmpty()


def test_log_count_ratios():
    pos, neg = np.array([9, 0, 4]), np.array([0, 9, 4])
    r = toxicity.log_count_ratios(pos, neg, 10, 10)
    assert r == pytest.approx([math.log(10 / 1), -math.log(10 / 1), 0])
    small = toxicity.shrunk(r, pos, neg, 1.0)
    assert small[0] == pytest.approx(r[0] * (1 - (1 / 10 + 1) / r[0] ** 2)) and small[1] == -small[0] and small[2] == 0
    assert (toxicity.shrunk(r, pos, neg) == 0).all()  # ten texts prove nothing at three errors


def plain_buckets(text):
    """Distinct hashes of all n-grams, one at a time."""
    c, out, cut = [ord(x) for x in f" {text.lower()} "], set(), (1 << 64) - 1
    for n in toxicity.SIZES:
        for i in range(len(c) - n + 1):
            h = 0
            for x in c[i : i + n]:
                h = (h * int(toxicity._STEP) + x) & cut
            out.add(((h + n) * int(toxicity._SPREAD) & cut) >> (64 - toxicity.BITS))
    return out


def test_counts_and_scores_against_a_loop(spark):
    texts = [t for t in cases.texts(3, 20) if len(t or "") < 900]
    labels = [i % 3 == 0 for i in range(len(texts))]
    df = spark.createDataFrame([(t, int(y)) for t, y in zip(texts, labels, strict=True)], "text string, label int").repartition(3)
    got = {r["bucket"]: (r["pos"], r["neg"]) for r in toxicity.class_counts(df).collect()}
    counts = [Counter(b for t, y in zip(texts, labels, strict=True) if y == kind for b in plain_buckets(t or "")) for kind in (True, False)]
    assert got == {b: (counts[0][b], counts[1][b]) for b in counts[0] | counts[1]}
    weights = np.random.default_rng(1).normal(0, 0.01, 1 << toxicity.BITS).astype(np.float32)
    rows = toxicity.score_toxicity(df.withColumn("doc_id", F.lit(1).cast("long")), None, model={"weights": weights, "intercept": -0.5}).select("score").collect()
    want = sorted(1 / (1 + math.exp(0.5 - sum(float(weights[b]) for b in plain_buckets(t or "")))) for t in texts)
    assert sorted(r["score"] for r in rows) == pytest.approx(want, abs=1e-9)


def test_settings_are_compared_on_training_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    hidden = labels.withColumn("toxic", F.when(common.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got, want = (toxicity.compared(docs, x, [{"errors": 3.0}]) for x in (hidden, labels))
    assert got == want and got[0]["rows"] > 30 and got[0]["right"] / got[0]["rows"] > 0.8


def test_labels_without_documents_count_for_nothing(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    absent = spark.range(10_000_000, 10_020_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    got, want = (toxicity.train(docs, x) for x in (labels.union(absent), labels))
    assert (got["weights"] == want["weights"]).all() and got["intercept"] == want["intercept"]


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_of_known_mixtures(share):
    rng = np.random.default_rng(1)
    draw = lambda n, at: np.hstack([rng.normal(at, 1, (n, 3)), np.ones((n, 1))]).astype(np.float32)
    pos, n = draw(4000, 2.0), int(8000 * share)
    unl = rng.permutation(np.vstack([draw(n, 2.0), draw(8000 - n, -2.0)]))
    assert quality.estimate_prior(pos, quality.Rows(unl[::2]), quality.Rows(unl[1::2])) == pytest.approx(share, abs=0.05)


def test_non_negative_step():
    p, u, w = np.array([[1.0], [2.0]]), np.array([[-1.0], [0.5]]), np.array([0.3])
    s = lambda x: 1 / (1 + math.exp(-0.3 * x))
    loss, grad = quality.unlabelled_terms(quality.Rows(u), w, np.zeros(1), np.ones(1))
    assert loss == pytest.approx(sum(math.log(1 + math.exp(0.3 * x)) for x in (-1, 0.5)) / 2)
    second = lambda prior: (s(-1) * -1 + s(0.5) * 0.5) / 2 - prior * (s(1) * 1 + s(2) * 2) / 2
    first = lambda prior: -prior * ((1 - s(1)) * 1 + (1 - s(2)) * 2) / 2
    _, below, g, ahead = quality.non_negative(0.1)(p, w, loss, grad)
    assert g[0] == pytest.approx(first(0.1) + second(0.1)) and below == 0 and ahead is None
    _, below, g, ahead = quality.non_negative(0.95)(p, w, loss, grad)  # its second term is negative
    assert below < 0 and ahead[0] == pytest.approx(second(0.95)) and g[0] == pytest.approx(first(0.95))


def test_unlabelled_sums_take_every_row(spark, monkeypatch):
    """Risk and gradient of 200 texts in 7 partitions against a loop over them, gathered either way."""
    texts = (cases.texts(4, 120) * 2)[:200]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    table = common.written(quality._features(df), "features")
    x = np.vstack([quality.expand(quality.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))) for b in ((t or "").encode() for t in texts)]).astype(float)
    rng = np.random.default_rng(2)
    pos = x[:50].astype(np.float32)
    centre, scale = quality.moments(quality.Table(table), pos)
    both = np.vstack([x, x[:50]])
    assert centre[:-1] == pytest.approx(both.mean(0)[:-1], abs=1e-5) and scale[:-1] == pytest.approx(both.std(0)[:-1] + 1e-3, abs=1e-5)
    w = rng.normal(0, 0.1, x.shape[1])
    z = (x - centre) / scale
    loss = grad = 0
    for row in z:
        f = row @ w
        loss, grad = loss + math.log1p(math.exp(-abs(f))) + max(f, 0), grad + row / (1 + math.exp(-f))
    for most in (512, 1):
        monkeypatch.setattr(quality, "MOST_PARTS", most)
        got, ahead = quality.unlabelled_terms(quality.Table(table), w, centre, scale)
        assert got == pytest.approx(loss / 200, rel=1e-4) and ahead == pytest.approx(grad / 200, abs=1e-4)


def test_quasi_newton_steps_reach_the_least_risk():
    rng = np.random.default_rng(5)
    draw = lambda n, at: np.hstack([rng.normal(at, [1, 3, 1], (n, 3)), np.ones((n, 1))])
    p, u = draw(300, 1.0), np.vstack([draw(300, 1.0), draw(500, -1.0)])
    centre, scale = np.zeros(4), np.ones(4)
    w = quality.minimise(quality.Rows(u), p, centre, scale, quality.non_negative(0.3), 40)
    _, _, g, _ = quality.non_negative(0.3)(p, w, *quality.unlabelled_terms(quality.Rows(u), w, centre, scale))
    assert np.abs(g + 1e-3 * w).max() < 1e-4


def test_keep_good_keeps_columns(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = labels.where("quality = 1").join(docs, "doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()


def winnowed(b, hashes, k=16, w=64):
    n = len(b)
    if n < k:
        return [(hashes[0], 0)] if n else []
    if n < k + w - 1:
        m = min(hashes)
        return [(m, max(i for i, h in enumerate(hashes) if h == m))]
    out = set()
    for i in range(len(hashes) - w + 1):
        m = min(hashes[i : i + w])
        out.add((max(j for j in range(i, i + w) if hashes[j] == m), m))
    return [(h, j) for j, h in sorted(out)]


def test_winnowing(spark):
    texts = cases.texts(3, 20)
    docs = cases.documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 30"))
    got = {r["doc_id"]: r for r in winnow.edited_fingerprints(docs).collect()}
    order = sorted(got, reverse=True)
    text = {i * 3: t or "" for i, t in enumerate(texts)}
    edited = {}
    for i, d in enumerate(order):
        t, nxt = text[d], text[order[(i + 1) % len(order)]]
        m = len(t) // 3
        edited[d] = t[: len(t) - m] + nxt[:m]
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited[d].encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    blocks = {bytes(t.encode()[i : i + 4]) for t in [*text.values(), *edited.values()] for i in range(len(t.encode()) - 3)}
    number = {bytes(r[0]): r[1] for r in spark.createDataFrame([(bytearray(b),) for b in blocks], "b binary").select("b", F.xxhash64("b")).collect()}
    tiny = {r[0]: r[1] >> 32 for r in spark.createDataFrame([(t,) for t in [*text.values(), *edited.values()] if 0 < len(t.encode()) < 16], "t string").select("t", F.xxhash64("t")).collect()}

    def grams(t, k=16):
        b, h = t.encode(), [0] * 4  # a hash rolls on from that of four bytes before
        out, whole = [], (1 << 64) - 1
        for i in range(3, len(b)):
            h[i % 4] = (h[i % 4] << 1 ^ number[b[i - 3 : i + 1]]) & whole
            if i >= k + 3:
                h[i % 4] ^= number[b[i - k - 3 : i - k + 1]] << 4 & whole
            if i >= k - 1:
                out.append((h[i % 4] >> 32) - (h[i % 4] >> 63 << 32))
        return out or [tiny.get(t)]

    chosen = {}
    for which, ts in (("fingerprint", text), ("edited_fingerprint", edited)):
        for d, t in ts.items():
            chosen[which, d] = winnowed(t.encode(), grams(t))
            assert got[d][which] == " ".join(f"{h & 0xFFFFFFFF:X}@{p:X}" for h, p in chosen[which, d])

    def likeness(x, y):
        x, y = {h for h, _ in x}, {h for h, _ in y}
        return len(x & y) / len(x | y) if x | y else 1.0

    for i, d in enumerate(order):
        own = chosen["fingerprint", d]
        assert got[d]["near_edited"] == pytest.approx(likeness(own, chosen["edited_fingerprint", d]))
        assert got[d]["near_next"] == pytest.approx(likeness(own, chosen["fingerprint", order[(i + 1) % len(order)]]))
    assert winnow.edited_fingerprints(cases.empty(spark)).isEmpty()
    ends = spark.createDataFrame([(-(2**63), "a", "", "", 1), (2**63 - 1, "b", "", "", 1), (None, "c", "", "", 1), (0, "ddd", "", "", 3)], cases.SCHEMA)
    got = {r["doc_id"]: r["edited_sha256"] for r in winnow.edited_fingerprints(ends).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in ((-(2**63), "a"), (2**63 - 1, "b"), (None, "c"), (0, "dda"))}


@pytest.mark.parametrize("k, grams", [(5, 7), (12, 1), (1, 33)])
def test_windows_of_other_sizes(spark, k, grams):
    texts = ["abcdefghij" * 5, "".join(random.Random(k).choice("ab") for _ in range(700))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", winnow.winnowed(F.col("t").cast("binary"), k, grams)).collect()
    number = {t: h >> 32 for t, h in zip("abcdefghij", spark.createDataFrame([(c,) for c in "abcdefghij"], "c string").select(F.xxhash64("c")).toPandas().iloc[:, 0])} if k == 1 else None
    for t, fp in rows:
        at = [0xFFFFFFFF - (x & 0xFFFFFFFF) for x in fp]
        assert at == sorted(set(at)) and all(b - a <= grams for a, b in zip(at, at[1:])) and at[0] < grams and at[-1] >= len(t) - k - grams + 1
        same = {}
        assert all(same.setdefault(t[p : p + k], x >> 32) == x >> 32 for p, x in zip(at, fp))
        assert number is None or all(number[t[p]] == x >> 32 for p, x in zip(at, fp))


def test_windows_look_at_low_hashes(spark):
    """Few grams are looked at for the least of a window, and none is lost: falling, rising, equal and extreme hashes, windows without a low one, and texts of both kinds."""
    rnd, w = random.Random(12), 64
    some = lambda n: [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    cases_of = [some(2126), sorted(some(500)), sorted(some(500), reverse=True), [-(1 << 63)] * 300, [(1 << 63) - 1] * 300, some(64), some(65)]
    cases_of += [some(300) + [(1 << 63) - 1 - i % 7 for i in range(w)] + some(300), [i << 40 for i in range(200)], [-(1 << 63) + (abs(i - 90) << 34) for i in range(180)], (some(40) * 9)[:350]]
    cases_of += [[-(1 << 63) + (rnd.randrange(3) << 32) for _ in range(400)]]
    df = spark.createDataFrame(list(enumerate(cases_of)), "i int, a array<bigint>").withColumn("start", F.lit(70000).cast("long"))
    got = df.select("i", winnow._chosen(F.col("a"), F.col("start"), w), F.size(winnow._low(F.col("a"), (winnow.LOW << 64) // w - (1 << 63)))).collect()
    for i, fp, looked in got:
        h = [x >> 32 for x in cases_of[i]]
        assert [(x >> 32, 0xFFFFFFFF - (x & 0xFFFFFFFF) - 70000) for x in fp] == winnowed(bytes(len(h) + 15), h), i
        assert i or looked < len(h) / 4
    texts = ["x" * 5000, "".join(rnd.choice("abcdefghij ") for _ in range(9000)), ("".join(rnd.choice("abc") for _ in range(83)) * 60), "a" * 2100 + "".join(rnd.choice("abcdefghij ") for _ in range(2100))]
    data = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").cast("binary").alias("b"))
    for t, fp, hashes in data.select("t", winnow.winnowed(F.col("b")), winnow._hashes(F.col("b"), 16)).collect():
        assert [(x >> 32, 0xFFFFFFFF - (x & 0xFFFFFFFF)) for x in fp] == winnowed(t.encode(), [x >> 32 for x in hashes])


def test_lm_scores_equal_sql(spark):
    docs = cases.documents(spark)
    con = duckdb.connect()
    con.register("frame", docs.select("doc_id", "text").toPandas())
    con.execute("create table documents as select doc_id, text from frame")
    want = {r[0]: r[1:] for r in con.execute(lmscore.OP6_SQL).fetchall()}
    got = {r[0]: r[1:] for r in rows(lmscore.score_documents(docs))}
    assert got.keys() == want.keys()
    for d, (n, score, off) in got.items():
        assert (n, off) == (want[d][0], want[d][2]) and math.isclose(score, want[d][1], abs_tol=1e-4)
    assert lmscore.score_documents(cases.empty(spark)).isEmpty()


def test_lm_trigrams_by_brute_force(spark):
    docs = cases.documents(spark, cases.texts(5, 15))
    words = {r["doc_id"]: cases.WORDS.findall((r["text"] or "").translate(cases.LOWER)) for r in docs.collect()}
    own = {d: Counter(tuple(w[i : i + g]) for g in (1, 2, 3) for i in range(len(w) - g + 1)) + Counter({(): len(w)}) for d, w in words.items()}
    total = sum(own.values(), Counter())
    for d, _, score, _ in rows(lmscore.score_documents(docs, order=3)):
        want, w = 0.0, words[d]
        c = lambda g, d=d: total[g] - own[d][g]
        for i in range(len(w)):
            most = min(i, 2)
            for back in range(most, -1, -1):
                g = tuple(w[i - back : i + 1])
                if c(g) > 0 and c(g[:-1]) > 0:
                    want += math.log10(c(g) / c(g[:-1])) + (most - back) * math.log10(0.4)
                    break
            else:
                want += math.log10(1 / (c(()) + 1)) + most * math.log10(0.4)
        assert math.isclose(score, want, abs_tol=1e-6)


def test_lm_scores_of_a_hot_row(spark):
    """Fifty thousand copies of one row with a null id, dealt as one row; each copy is told from the others."""
    many, others = 50_000, [(1, "a b a c"), (1, "b c d"), (2, "a b c"), (2, "a b c"), (None, None), (None, "")]
    hot = spark.range(many).select(F.lit(None).cast("long").alias("doc_id"), F.lit("A b c a").alias("text"))
    docs = hot.union(spark.createDataFrame(others, "doc_id long, text string"))
    counted = lmscore._counted_rows(docs.withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    assert sorted(r["copies"] for r in counted.collect()) == [1, 1, 2, 2, many]
    got = Counter((d, n, round(s, 9), b) for d, n, s, b in rows(lmscore.score_documents(docs)))
    words = Counter({(None, "a b c a"): many}) + Counter((d, t or "") for d, t in others)
    grams = {t: Counter(tuple(t.split()[i : i + g]) for g in (0, 1, 2) for i in range(len(t.split()) - max(g, 1) + 1)) for _, t in words}
    total = Counter()
    for (_, t), n in words.items():
        for g, c in grams[t].items():
            total[g] += n * c
    want = Counter()
    for (d, t), n in words.items():
        c, w, score, off = total - grams[t], t.split(), 0.0, 0
        for i in range(len(w)):
            for back in range(min(i, 1), -1, -1):
                g = tuple(w[i - back : i + 1])
                if c[g] and c[g[:-1]]:
                    score += math.log10(c[g] / c[g[:-1]])
                    break
            else:
                back, score = 0, score + math.log10(1 / (c[()] + 1))
            score, off = score + (min(i, 1) - back) * math.log10(0.4), off + (back < min(i, 1))
        want[d, len(w), round(score, 9), off] += n
    assert got == want


def test_passes_share_the_trigrams_of_a_chunk():
    """Each pass asks for a part of the n-grams, all passes for each n-gram once, with its count."""
    source = random.Random(6)
    texts = [" ".join(source.choices("abcdefghijklmnopqrstuvwxyz", k=700)).encode() for _ in range(4)]
    chunk = pa.table({"doc_id": [1, 2, 3, 4], "text": texts, "copies": [1, 3, 1, 300], "chunk": [9] * 4})
    say = lambda t: {(b // 5, int(h)): n for b, hs, ns in zip(*(t.column(c).to_pylist() for c in ("bucket", "h", "n"))) for h, n in zip(np.frombuffer(hs, "<u8"), lmscore._unpacked_counts(ns, len(hs) // 8))}
    whole = {h: n for (_, h), n in say(lmscore._asked(chunk, 3, 5, 1, 0)).items()}
    parts = [say(lmscore._asked(chunk, 3, 5, 3, now)) for now in range(3)]
    assert all({b for b, _ in part} == {now} and len(part) < 0.4 * len(whole) for now, part in enumerate(parts))
    assert sum(map(len, parts)) == len(whole) and {h: n for part in parts for (_, h), n in part.items()} == whole


def test_a_registered_query_scores_trigrams(spark):
    small = DATA.replace("0.01", "0.001")
    got = queries.QUERIES["op6_lm_scoring_order3"](spark, small)
    want = lmscore.score_documents(common.documents(spark, small), order=3).withColumn("score", F.round("score", 4))
    assert sorted(rows(got)) == sorted(rows(want.select(*got.columns)))
    assert sorted(rows(got)) != sorted(rows(queries.QUERIES["op6_lm_scoring"](spark, small).select(*got.columns)))


def linked(sets):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("hot", [1, 32])
def test_jaccard_join(spark, hot):
    docs = cases.documents(spark)
    docs = docs.union(docs.where("doc_id in (30, 33)"))
    sets = {r["doc_id"]: cases.shingles(r["text"]) for r in docs.collect()}
    want = cases.components(sorted(sets), linked(sets))
    members, links = jaccard.jaccard_join(docs, hot=hot)
    got = members.collect()
    assert len(got) == docs.count()
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]) for r in got)
    assert links.columns == ["a", "b"]
    assert jaccard.jaccard_join(cases.empty(spark))[0].isEmpty()


def passages(seed):
    """Texts made mostly of passages that many share: with few and many words of their own, cut, joined, varied, and templates."""
    rnd = random.Random(seed)
    own = lambda n: " ".join(f"o{rnd.randrange(10**6)}" for _ in range(n))
    whole = [[f"{c}{i}" for i in range(90)] for c in "pqr"]
    out = [" ".join(whole[0])]
    for _ in range(60):
        out.append(" ".join(whole[0]) + " " + own(24))
        out.append(" ".join(whole[rnd.randrange(3)]) + " " + own(rnd.randint(0, 20)))
        i = rnd.randrange(30)
        out.append(" ".join(whole[0][i : i + rnd.randint(50, 80)]) + " " + own(rnd.randint(0, 12)))
        a, b = rnd.sample(whole, 2)
        out.append(" ".join(a) + " " + " ".join(b[: rnd.randint(5, 90)]) + " " + own(rnd.randint(0, 6)))
        varied = list(whole[1])
        varied[rnd.randrange(90)] = "v"
        varied[rnd.randrange(90)] = own(1)
        out.append(" ".join(varied))
        out.append(f"order {own(1)} was shipped on day {rnd.randrange(9)} by the usual carrier")
        out.append(own(rnd.randint(1, 3)))
    return out


@pytest.mark.parametrize("hot, seed", [(2, 1), (8, 2)])
def test_jaccard_join_of_shared_passages(spark, hot, seed):
    docs = cases.documents(spark, passages(seed), clash=False)
    sets = {r["doc_id"]: cases.shingles(r["text"]) for r in docs.collect()}
    want = cases.components(sorted(sets), linked(sets))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(docs, hot=hot)[0].collect()}
    assert got == want


def test_maximal_repeats():
    text = [b"xxabcdefyy", b"zxabcdefyw", b"qqabcdefqq", b"qqabcdeaaa"]
    at = 2  # the anchor "abcde"
    left, right = [t[:at][::-1] for t in text], [t[at:] for t in text]
    got = {(l, r, tuple(sorted(own))) for l, r, own in repeats.maximal_repeats(left, right, 6)}
    assert (1, 7, (0, 1)) in got and (2, 5, (2, 3)) in got and (0, 6, (0, 1, 2)) in got
    assert list(repeats.prefix_intervals([3, 1, 2], 1)) == [(3, 0, 1), (2, 2, 3), (1, 0, 3)]


@pytest.mark.parametrize("hot", [1, 40, 2000])
def test_repeats(spark, hot):
    docs = cases.documents(spark)
    want = cases.removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    base, cleaned, _ = repeats.remove_repeats(docs, hot=hot)
    kept = {r["did"]: r for r in cleaned.collect()}
    for r in base.collect():
        n, gone, spans, rest = want[r["did"]]
        assert r["n_bytes"] == n
        if not r["first"] and n >= 100:
            assert (gone, spans, rest) == (n, 1, b"")
        elif r["did"] in kept:
            x = kept[r["did"]]
            assert (x["n_removed"], x["n_spans"], bytes(x["kept"])) == (gone, spans, rest)
        else:
            assert gone == 0
    assert repeats.remove_repeats(cases.empty(spark))[0].isEmpty()


@pytest.mark.parametrize("hot", [1, 2000])
def test_repeat_groups_hold_all_occurrences(spark, hot):
    docs = cases.documents(spark, clash=False)
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    firsts = {}
    for d in sorted(text):
        firsts.setdefault(text[d], d)
    groups = {}
    for r in repeats.repeat_groups(docs, hot=hot).collect():
        groups.setdefault((r["grp"], r["length"]), []).append((r["doc_id"], r["start"]))
    cover = {d: bytearray(len(t)) for d, t in text.items()}
    for (_, n), places in groups.items():
        strings = {text[d][i : i + n] for d, i in places}
        assert n >= 100 and len(strings) == 1 and len(places) > 1
        string = strings.pop()
        everywhere = {(d, i) for t, d in firsts.items() for i in range(len(t) - n + 1) if t.startswith(string, i)}
        assert set(places) <= everywhere and (n > 100 or set(places) == everywhere)
        for d, i in sorted(places)[1:]:
            cover[d][i : i + n] = b"\1" * n
    want = cases.removed([(d, t.decode()) for t, d in firsts.items()])
    assert all(sum(cover[d]) == want[d][1] for d in want)


def test_ids_at_both_ends(spark):
    low, high = -(2**63), 2**63 - 1
    text = "a passage of more than one hundred bytes that two documents share, so that the later of the two has to lose it: " * 2
    docs = spark.createDataFrame([(None, text, None, None, None), (high, text, None, None, None), (high, None, None, None, None), (low, "x", None, None, None), (low + 1, "y", None, None, None), (None, "z", None, None, None)], cases.SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in repeats.cleaned_documents(docs).collect()), key=str)
    assert got == sorted([(high, text[: len(text) // 2]), (high, None), (low, "x"), (low + 1, "y"), (None, "z")], key=str)
    for first in (False, True):
        there, back = common.ordered_ids(docs, null_first=first)
        ids = [r[0] for r in docs.select("doc_id", there.alias("at")).orderBy("at").select(back(F.col("at"))).collect()]
        real = sorted(x for x in ids if x is not None)
        assert ids == ([None, None, *real] if first else [*real, None, None]) and real == [low, low + 1, high, high]


def test_cleaned_documents_are_whole_characters(spark):
    docs = cases.documents(spark, ["é" * 90 + "x" * 40, "y" + "é" * 90 + "z" * 40, "é" * 90 + "x" * 40, None, ""])
    got = {r["doc_id"]: r for r in repeats.cleaned_documents(docs).collect()}
    assert set(got) == {0, 3, 9, 12}
    assert "�" not in got[3]["text"] and got[3]["n_chars"] == len(got[3]["text"])
    assert got[3]["shard"] == "1"


@pytest.mark.parametrize("block", [2048, 16])
def test_lattice(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24))
    x[100:180] = x[:80] + rng.normal(size=(80, 24)) * 0.05
    x[180:260] = x[5] + rng.normal(size=(80, 24)) * 0.15
    x[260:270] = x[7]
    data = [(i, v.tolist(), int(i % 2 == 0 and i < 100) if i % 50 else 1) for i, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [math.nan] * 24, 1), (903, [], 1), (904, data[0][1], None), (905, [None] + [1.0] * 23, 1), (906, data[0][1][:8], 1), (1, data[1][1], data[1][2])]
    df = spark.createDataFrame([(i, v, y, 1, 2) for i, v, y in data + odd], "vec_id long, embedding array<float>, label int, key int, many int")
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df).collect()}
    sound = [*data, odd[-1]]
    unit = np.array([v for _, v, _ in sound])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([y for *_, y in sound])
    link = (unit @ unit.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    ids = [i for i, *_ in sound]
    counts = {i: link[np.array(ids) == i].sum(1) for i in ids}  # the rows of one id have the same links
    assert all(got[i]["n_links"] <= counts[i].max() for i in ids)
    assert sum(got[i]["n_links"] for i in ids) >= 0.97 * link.sum()
    want = cases.components(set(ids), [(ids[a], ids[b]) for a, b in np.argwhere(link) if ids[a] != ids[b]])
    assert np.mean([got[i]["component_id"] == want[i] for i in ids]) > 0.97
    for i in (900, 901, 902, 903, 904, 905, 906):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert lattice.near_duplicates(df.limit(0)).isEmpty()


@pytest.mark.parametrize("labels, kind", [((0.2, 0.7), "double"), (("a", "b"), "string"), ((True, False), "boolean"), ((2**62, 2**62 + 1), "long")])
def test_labels_are_compared_as_they_are(spark, labels, kind):
    x, y = [1.0, 2.0, 3.0, 0.5], [1.0, 2.0, 3.0, 0.4]
    data = [(1, x, labels[0]), (2, y, labels[1]), (3, y, labels[0]), (4, x, labels[1]), (5, x, None), (-(2**63), x, labels[0]), (2**63 - 1, x, None)]
    df = spark.createDataFrame(data, f"vec_id long, embedding array<double>, label {kind}")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicates(df).collect()}
    low = -(2**63)
    assert got == {1: (2, low), 3: (2, low), low: (2, low), 2: (1, 2), 4: (1, 2), 5: (0, 5), 2**63 - 1: (0, 2**63 - 1)}


def test_lattice_points():
    assert len(lattice.shortest_vectors()) == 240
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 3
    p = lattice.nearest(x)
    assert (np.sqrt(((x - p) ** 2).sum(1)) <= 1 + 1e-9).all()
    for v in lattice.shortest_vectors():  # no neighbour is nearer
        assert (((x - p) ** 2).sum(1) <= ((x - p - v) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    small = DATA.replace("0.01", "0.001")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rel = con.execute(queries.ORACLE_SQL[name])
    at = [[c[0] for c in rel.description].index(c) for c in cols]
    assert sorted(rows(df.select(*cols)), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.documents(spark, DATA)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, before, DATA), name)
        if name != "tokens":
            assert after.columns == docs.columns
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        if name == "quality":
            assert not [i for i in ids if labels.get(i) == 0]
        if name == "near_duplicates":
            members, _ = jaccard.jaccard_join(after)
            assert members.where("n_shingles > 0").groupBy("component_id").count().where("count > 1").isEmpty()
        if name == "repeats":
            whole = cases.removed([(r["doc_id"], r["text"]) for r in before.collect()])
            left = {r["doc_id"]: r["text"] for r in after.collect()}
            assert all(abs(len(left[i].encode()) - len(whole[i][3])) <= 3 * whole[i][2] for i in left)
        before = after
    assert before.count() > 0


def test_near_duplicate_stage_with_shared_repeated_and_null_ids(spark):
    import corpus_pipeline

    rnd = random.Random(8)
    a, b, c, d, e = (" ".join(str(rnd.random()) for _ in range(30)) for _ in range(5))
    data = [(5, a), (9, a), (5, b), (2, b), (7, c), (7, c), (7, c), (None, d), (None, d), (5, e), (1, None), (3, " "), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in data], cases.SCHEMA)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, DATA)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(5, a), (2, b), (7, c), (None, d), (5, e), (1, None), (3, " ")], key=str)
    assert corpus_pipeline.near_duplicate_stage(spark, cases.empty(spark), DATA).isEmpty()


def test_null_ids_and_shared_ids(spark):
    """Rows without an id, and other texts under one id, crash nothing and lose no row."""
    texts = cases.texts(6, 12)
    data = [(None if i % 5 == 0 else i // 2, t, None, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, cases.SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    n = docs.count()
    assert mixing.mixed_documents(docs).count() == n
    assert bpe.digests(docs).count() == n
    assert toxicity.score_toxicity(docs, labels).count() == n
    assert quality.score_quality(docs, labels).count() == n
    assert lmscore.score_documents(docs).count() == n
    assert winnow.edited_fingerprints(docs).count() == n
    members, _ = jaccard.jaccard_join(docs, hot=2)
    assert members.count() == n
    base, *_ = repeats.remove_repeats(docs)
    assert base.count() == n
    assert sharding.interleave(docs, 4, F.col("source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).count() == n
    assert repeats.cleaned_documents(docs).where("text is not null").count() < n


def test_stages_on_odd_tables(spark):
    """Quality, repeats, mixture and tokens with null, empty and repeated texts, null and shared ids, and columns of clashing names."""
    import corpus_pipeline

    texts = cases.texts(9, 10)
    data = [(None if i % 7 == 3 else i // 2, t, None if i % 4 == 1 else "en", None if i % 5 == 2 else "web", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data + data[:6], cases.SCHEMA).withColumns({c: F.lit(v) for c, v in cases.CLASH.items()})
    given = Counter((r["doc_id"], r["text"]) for r in docs.collect())

    good = corpus_pipeline.quality_stage(spark, docs, DATA)
    assert tuple(good.columns) == corpus_pipeline.COLUMNS
    kept = Counter((r["doc_id"], r["text"]) for r in good.collect())
    assert all(given[k] == n for k, n in kept.items())  # equal rows share their fate

    whole = corpus_pipeline.repeats_stage(spark, docs, DATA)
    assert tuple(whole.columns) == corpus_pipeline.COLUMNS
    bare = Counter(k for k in given.elements() if not k[1])
    assert Counter((r["doc_id"], r["text"]) for r in whole.collect() if not r["text"]) == bare

    mixed = corpus_pipeline.mixing_stage(spark, docs, DATA)
    assert not Counter((r["doc_id"], r["text"]) for r in mixed.collect()) - given

    coded = corpus_pipeline.token_stage(spark, docs, DATA).collect()
    vocabulary = bpe.load_vocabulary(bpe.vocabulary_path())["tokens"]
    decoded = lambda r: b"".join(vocabulary[i] for i in np.frombuffer(bytes(r["ids"]), "<u4")).decode()
    assert Counter((r["doc_id"], decoded(r)) for r in coded) == Counter((i, t or "") for i, t in given.elements())
    for r in coded:
        assert r["n_tokens"] * 4 == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded(r).encode()).hexdigest()

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.empty(spark), DATA).isEmpty()

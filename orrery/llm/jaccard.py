"""Exact Jaccard join of word shingles by grouped prefixes, reported as components.

Documents with the same shingle set are one class; classes with the same
prefix and set size are one group, and only groups are joined.

The prefix. Shingles are ordered by (kind, hash): first the *low* ones, whose
hash is under a fixed share of the range, then the others, last all *hot* ones,
that more than `hot` groups hold. This is one order of all shingles, so two
sets with enough overlap share a shingle among the first n - ceil(t n) + 1 of
each. Most sets have that many low shingles that are not hot: their prefix is
found from the low ones alone. The rest, short sets and those with much text
that many documents hold, are *deep*: their other shingles are joined among
themselves. Only sets made mostly of hot shingles go on to join those.

A shingle is hot if more than `hot` classes hold it, so every list that is
joined pair by pair, and every group in it, has `hot` classes at most. A task
that finds a shingle hot among its own documents ships no list of it at all.

Two sets that share no shingle but hot ones share exactly what their hot parts
share. So sets with one hot part are collapsed too, and among them and between
two hot parts the sizes alone decide: if any two sets link, the least set of
each part does, and every other set that links at all links with such a least
one. That needs one row a set. Hot parts are joined on the shingles of their
prefixes, where one of the two must have few shingles before the first that
they share.

Links between sets that are in one component anyway need no check. So few
pairs of each list are checked first, and then only those whose components
still differ. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textpack

#: Share of the hash range whose shingles are low; must exceed 1 - threshold.
LOW_SHARE = 0.32
#: A shingle in more classes than this goes to the end of the order.
HOT = 32
#: Ids up to this number (some 10 MB) are broadcast, more are joined by a shuffle.
MOST_BROADCAST = 250_000
_LOW = np.uint64(int(LOW_SHARE * 2**64))
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _set_hash(tokens: np.ndarray, n: int, salt: np.uint64) -> int:
    total = np.add.reduce(textpack.mix(tokens * salt), dtype=np.uint64, keepdims=True)
    return int(textpack.mix(total + np.uint64(n * int(salt) & textpack.MASK))[0].view(np.int64))


def _sets(buf: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    h, at = textpack.words(buf, offs)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield textpack.shingles(h[a:b], k)


def _key(tokens: np.ndarray) -> int:
    return _set_hash(tokens, len(tokens), _A)


def _group(tokens: np.ndarray) -> tuple[int, np.ndarray]:
    low = tokens[: np.searchsorted(tokens, _LOW)]
    return _set_hash(low, len(tokens), _B), low


def text_hash(text: Column | str) -> Column:
    """What tells apart the texts of one doc_id; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n, key, gid, n_low): set size, class, group and number of low shingles of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in textpack.slices(batch, "text"):
                rows = [(len(s), _key(s), *((g, len(low)) if len(s) else (0, 0))) for s in _sets(buf, offs, k) for g, low in [_group(s)]]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["doc_id", "text_hash", "n", "key", "gid", "n_low"])

    return docs.withColumn("text_hash", text_hash("text")).mapInArrow(run, "doc_id long, text_hash long, n long, key long, gid long, n_low long")


def _dealt(bucket: np.ndarray, columns: list[np.ndarray], names: list[str], kind: int | None = None) -> pa.RecordBatch:
    """One row for each bucket, with the packed values of its entries."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, int)
    ends = np.append(cut[1:], len(b)) if len(b) else cut
    packs = []
    for c in columns:
        c = np.ascontiguousarray(c[order])
        packs.append(pa.array([c[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()))
    first = [pa.array(b[cut].astype(np.int32), pa.int32())]
    if kind is not None:
        first = [pa.array(np.full(len(cut), kind, np.int32)), *first]
    return pa.RecordBatch.from_arrays([*first, *packs], names=names)


def _gathered(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


_POSTED = ["kind", "bucket", "tokens", "owners", "sizes", "weights"]


def _postings(texts: DataFrame, k: int, buckets: int, hot: int, low: bool) -> DataFrame:
    """Kind 0: (bucket, tokens, owners, sizes, weights), packed by hash of the shingle, once a task's chunk and owner. Kind 1: shingles that are hot in a chunk, packed by hash of the owner.

    low: the low shingles of every group; its weight counts its classes. Else: the other shingles of the deep classes in column `key`.
    Of a shingle that a chunk holds in more than `hot` classes only one posting goes by the shingle.
    """

    def dealt(seen: dict[int, tuple[np.ndarray, int, set[int]]]) -> Iterator[pa.RecordBatch]:
        many = np.array([len(x) for x, _, _ in seen.values()])
        tokens = np.concatenate([x for x, _, _ in seen.values()])
        owners = np.repeat(np.fromiter(seen, np.int64, len(seen)), many)
        sizes = np.repeat(np.array([n << 32 for _, n, _ in seen.values()], np.int64) | many, many)
        weights = np.repeat(np.array([len(c) for *_, c in seen.values()], np.uint32), many)
        order = np.argsort(tokens, kind="stable")
        tokens, owners, sizes, weights = (x[order] for x in (tokens, owners, sizes, weights))
        start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        total = np.add.reduceat(weights, start)
        often = np.repeat(total > hot, np.diff(np.append(start, len(tokens))))
        weights[start] = np.where(total > hot, total, weights[start])
        ship = ~often
        ship[start] = True
        yield _dealt((textpack.mix(tokens[ship]) % np.uint64(buckets)).astype(np.int64), [x[ship] for x in (tokens, owners, sizes, weights)], _POSTED, 0)
        if often.any():
            x, none = owners[often], np.zeros(int(often.sum()), np.int8)
            yield _dealt((textpack.mix(x.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), [tokens[often], x, none, none], _POSTED, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, int, set[int]]] = {}
        held = 0
        for batch in batches:
            for part, buf, offs in textpack.slices(batch, "text"):
                keys = None if low else part.column("key").to_pylist()
                for i, s in enumerate(_sets(buf, offs, k)):
                    key = _key(s)
                    if low:
                        owner, own = _group(s)
                    elif key == keys[i]:  # else another text under the same doc_id
                        owner, own = key, s[np.searchsorted(s, _LOW) :]
                    else:
                        continue
                    if len(own) and owner not in seen:
                        seen[owner] = own.copy(), len(s), {key}
                        held += len(own)
                    elif len(own):
                        seen[owner][2].add(key)
                if held > 400_000:
                    yield from dealt(seen)
                    seen, held = {}, 0
        if seen:
            yield from dealt(seen)

    return texts.select("text", *([] if low else ["key"])).mapInArrow(run, "kind int, bucket int, tokens binary, owners binary, sizes binary, weights binary")


_FOUND = ["kind", "part", "x", "y", "c", "nx", "ny"]


def _join_bucket(table: pa.Table, parts: int, hot: int, num: int, den: int) -> pa.Table:
    """Kind 0: pairs of owners that share shingles of short lists, with how many. Kind 1: (owner, shingle) of hot ones. Packed by a hash of the owner."""
    tokens, gids = (_gathered(table, c, t) for c, t in (("tokens", "<u8"), ("owners", "<i8")))
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in _FOUND[2:])])

    def hot_rows(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(len(x), np.int8)
        return _dealt((textpack.mix(x.view(np.uint64)) % np.uint64(parts)).astype(np.int64), [x, y.view(np.int64), none, none, none], _FOUND, 1)

    if table.column("kind")[0].as_py() == 1:
        return pa.Table.from_batches([hot_rows(gids, tokens)], schema)
    sizes, weights = _gathered(table, "sizes", "<i8"), _gathered(table, "weights", "<u4").astype(np.int64)
    order = np.lexsort((gids, tokens))
    tokens, gids, sizes, weights = (x[order] for x in (tokens, gids, sizes, weights))
    new = np.flatnonzero(np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (gids[1:] != gids[:-1]))))
    weights = np.add.reduceat(weights, new)
    tokens, gids, sizes = tokens[new], gids[new], sizes[new]
    start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    length, total = np.diff(np.append(start, len(tokens))), np.add.reduceat(weights, start)
    left, right = [], []
    for n in np.unique(length):
        if 2 <= n <= hot:
            i, j = np.triu_indices(n, 1)
            s = start[(length == n) & (total <= hot)]
            left.append((s[:, None] + i).ravel())
            right.append((s[:, None] + j).ravel())
    out = []
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        na, nb = sizes[a] >> 32, sizes[b] >> 32
        near = den * np.minimum(na, nb) >= num * np.maximum(na, nb)
        a, b = a[near], b[near]
        x, y = gids[a], gids[b]
        order = np.lexsort((y, x))
        x, y, a, b = x[order], y[order], a[order], b[order]
        if len(x):
            cut = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            count = np.diff(np.append(cut, len(x))).astype(np.int32)
            x, y = x[cut], y[cut]
            part = (textpack.mix(x.view(np.uint64) * _A + y.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            out.append(_dealt(part, [x, y, count, sizes[a[cut]], sizes[b[cut]]], _FOUND, 0))
    long = np.repeat(total > hot, length)
    if long.any():
        out.append(hot_rows(gids[long], tokens[long]))
    return pa.Table.from_batches(out, schema) if out else schema.empty_table()


def _sum_pairs(table: pa.Table) -> pa.Table:
    x, y, nx, ny = (_gathered(table, c, "<i8") for c in ("x", "y", "nx", "ny"))
    c = _gathered(table, "c", "<i4").astype(np.int64)
    order = np.lexsort((y, x))
    x, y, c, nx, ny = x[order], y[order], c[order], nx[order], ny[order]
    cut = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    cols = [x[cut], y[cut], np.add.reduceat(c, cut), nx[cut] >> 32, nx[cut] & 0xFFFFFFFF, ny[cut] >> 32, ny[cut] & 0xFFFFFFFF]
    return pa.table(cols, names=["x", "y", "c", "nx", "lx", "ny", "ly"])


def _sum_hot(table: pa.Table) -> pa.Table:
    x, y = _gathered(table, "x", "<i8"), _gathered(table, "y", "<u8")
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    x, y = x[new], y[new]
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    ends = np.append(cut[1:], len(x))
    return pa.table([pa.array(x[cut]), pa.array(ends - cut, pa.int64()), pa.array([y[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())], names=["gid", "n_hot", "hot"])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (with doc_id and text_hash) joined to its documents' texts: broadcast up to MOST_BROADCAST rows, else by a shuffle."""
    few = wanted.count() <= MOST_BROADCAST
    wanted = wanted.withColumnsRenamed({"doc_id": "rep", "text_hash": "rep_hash"})
    docs = docs.withColumn("text_hash", text_hash("text"))
    same = docs["doc_id"].eqNullSafe(wanted["rep"]) & (docs["text_hash"] == wanted["rep_hash"])
    return docs.join(F.broadcast(wanted) if few else wanted, same).drop("rep", "rep_hash", "doc_id", "text_hash")


def _near_pairs(postings: DataFrame, parts: int, hot: int, num: int, den: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) of owners that share enough of the posted shingles to be near, and (gid, n_hot, hot) of owners of hot ones."""
    found = postings.groupBy("kind", "bucket").applyInArrow(lambda t: _join_bucket(t, parts, hot, num, den), "kind int, part int, x binary, y binary, c binary, nx binary, ny binary")
    found = common.written(found, f"{name}-found")
    hot_of = common.written(found.where("kind = 1").groupBy("part").applyInArrow(_sum_hot, "gid long, n_hot long, hot binary"), f"{name}-hot")
    pairs = found.where("kind = 0").groupBy("part").applyInArrow(_sum_pairs, "x long, y long, c long, nx long, lx long, ny long, ly long")
    n_hot = lambda c: hot_of.select(F.col("gid").alias(c), F.col("n_hot").alias("h" + c))
    # sets that near differ in few shingles, so they share most of the posted ones
    apart = F.floor((F.col("nx") + F.col("ny")) * (den - num) / (den + num))
    short = F.col("lx") + F.col("ly") - apart - 2 * F.col("c")
    pairs = pairs.where(short <= 2 * F.least("lx", "ly"))
    pairs = pairs.join(n_hot("x"), "x", "left").join(n_hot("y"), "y", "left").fillna(0, ["hx", "hy"]).where(short <= 2 * F.least("hx", "hy"))
    pairs = common.written(pairs.select("x", "y"), f"{name}-pairs")
    common.drop_written(found)
    return pairs, hot_of


def _prefixes(heads: DataFrame, num: int, den: int) -> DataFrame:
    """(token, hid, n, rest) of the shingles in the prefix of each hot part, for its least set; rest counts the part's shingles from this one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hid, n, hot in zip(*(batch.column(c).to_pylist() for c in ("hid", "n", "hot")), strict=True):
                whole = np.frombuffer(hot, "<i8")
                tokens = whole[: max(len(whole) + (-n * num // den) + 1, 0)]
                rest = np.arange(len(whole), len(whole) - len(tokens), -1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array([hid] * len(tokens), pa.string()), pa.array(np.full(len(tokens), n)), pa.array(rest)], names=["token", "hid", "n", "rest"])

    return heads.select("hid", "n", "hot").mapInArrow(run, "token long, hid string, n long, rest long")


def _near_parts(heads: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, both) of the pairs of hot parts whose least sets link by what the parts share, both shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [len(np.intersect1d(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), assume_unique=True)) for a, b in zip(batch.column("hot_x").to_pylist(), batch.column("hot_y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "y", "n")), pa.array(both, pa.int64())], names=["x", "y", "n", "both"])

    side = lambda s: heads.select(F.col("hid").alias(s), F.col("n").alias("n_" + s), F.col("hot").alias("hot_" + s))
    joined = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("n", F.col("n_x") + F.col("n_y"))
    found = joined.select("x", "y", "n", "hot_x", "hot_y").mapInArrow(run, "x string, y string, n long, both long")
    return common.written(found.where((num + den) * F.col("both") >= num * F.col("n")).select("x", "y", "both"), "near-parts")


def _apart(tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of hot parts that share a shingle of their prefixes, may be near, and are not of one component. tokens: (token, hid, n, rest, lo, hi), lo and hi the least and largest component of a part's sets.

    The commonest component of a list is not joined with itself. Of two near
    sets at least one has no more than (den - num) / (den + num) of its
    shingles before the first that they share.
    """
    mixed = tokens.groupBy("token").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least <> most").select("token")
    tokens = tokens.join(mixed, "token")
    usual = tokens.where("lo = hi").groupBy("token", "lo").agg(F.count("*").alias("many")).groupBy("token").agg(F.max_by("lo", F.struct("many", "lo")).alias("usual"))
    tokens = tokens.join(usual, "token", "left")
    tokens = tokens.withColumns({"odd": ~(F.col("lo") == F.col("hi")) | (F.col("lo") != F.col("usual")), "light": (num + den) * (F.col("n") - F.col("rest")) <= (den - num) * F.col("n")})
    tokens = common.written(tokens.select("token", "hid", "n", "rest", "lo", "hi", "odd", "light"), "prefixes")
    side = lambda s: tokens.select(*[F.col(c).alias(c + "_" + s) for c in tokens.columns])
    differ = ~((F.col("lo_x") == F.col("hi_x")) & (F.col("lo_y") == F.col("hi_y")) & (F.col("lo_x") == F.col("lo_y")))
    enough = (num + den) * F.least("rest_x", "rest_y") >= num * (F.col("n_x") + F.col("n_y"))
    on = (F.col("token_x") == F.col("token_y")) & (F.col("hid_x") != F.col("hid_y")) & differ & enough
    found = side("x").where("odd_x and light_x").join(side("y"), on).union(side("x").where("odd_x and not light_x").join(side("y").where("light_y"), on))
    return found.select(F.least("hid_x", "hid_y").alias("x"), F.greatest("hid_x", "hid_y").alias("y")).distinct()


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are near enough, from their whole texts."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = common.written(ends.join(classes.select("key", "rep.doc_id", "rep.text_hash"), "key"), "ends")
    texts = _texts(docs, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list[int], list[int]] = [], []
            step = 500
            for i in range(0, len(batch), step):
                part = batch.slice(i, step)
                known: dict[bytes, np.ndarray] = {}

                def of(text: bytes, known: dict = known) -> np.ndarray:
                    if text not in known:
                        known[text] = next(_sets(*textpack.packed(pa.array([text], pa.binary())), k))
                    return known[text]

                for a, b, ta, tb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                    x, y = of(ta), of(tb)
                    if _key(x) != a or _key(y) != b:
                        continue  # another text under the same doc_id
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    joined = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    return common.written(joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct(), "links")


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n_shingles, class_id, component_id, text_hash, component) and links (a, b) between classes.

    A set is the distinct k-word shingles of a text in lower case (A-Z); a text
    of fewer words is one shingle. Two documents link when
    den * |intersection| >= num * |union|. component_id is the least doc_id
    that links reach. Every link between classes joins members of one
    component; the link table spans each component. component is its least
    class, which no other has, whatever ids they share.

    Null texts count as empty; texts without words have n_shingles 0, class
    null, link with nothing and are their own component. Rows of one doc_id
    with different texts are separate documents; a component's id is its least
    doc_id that is not null. Equal sets are one class. Long texts are taken
    whole. Other columns are not read. An empty table gives no rows.

    Shingles and sets are told apart by 64-bit hashes, hot parts by MD5.
    """
    if LOW_SHARE <= 1 - num / den:
        raise ValueError("the threshold is too low for the share of low shingles")
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    sets = common.written(shingle_sets(docs, k), "sets")
    some = sets.where("n > 0")
    rep = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    classes = common.written(some.groupBy("key", "gid", "n", "n_low").agg(F.min("doc_id").alias("doc_id"), F.min(rep).alias("rep")), "classes")
    buckets = max(common.partitions(spark, 4), sets.count() // 2000)
    parts = max(8, buckets // 16)  # a row goes from each bucket to each part
    group_pairs, hot_of = _near_pairs(_postings(docs, k, buckets, hot, True), parts, hot, num, den, "low")
    # deep classes
    prefix = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    counted = classes.join(hot_of.select("gid", "n_hot"), "gid", "left").withColumn("n_cold", F.col("n_low") - F.coalesce("n_hot", F.lit(0)))
    deep = counted.where(F.col("n_cold") < prefix).join(hot_of.select("gid", "hot"), "gid", "left")
    deep = common.written(deep.select("key", "n", "n_low", "n_cold", "hot", "rep"), "deep")
    deep_pairs, hot_high = _near_pairs(_postings(_texts(docs, deep.select("key", "rep.doc_id", "rep.text_hash")), k, buckets, hot, False), parts, hot, num, den, "high")
    hot_high = hot_high.select(F.col("gid").alias("key"), F.col("n_hot").alias("n_high"), F.col("hot").alias("hot_high"))
    hots = F.col("n_low") - F.col("n_cold") + F.coalesce("n_high", F.lit(0))
    # sets whose prefix holds hot shingles, by their hot part
    tails = deep.join(hot_high, "key", "left").withColumn("hots", hots).where(prefix - F.col("n") + F.col("hots") > 0)
    none = F.lit(b"")
    tails = tails.select("key", "n", "hots", F.concat(F.coalesce("hot", none), F.coalesce("hot_high", none)).alias("hot")).withColumn("hid", F.md5("hot"))
    tails = common.written(tails, "tails")
    heads = tails.groupBy("hid").agg(F.min(F.struct("n", "key")).alias("lead"), F.first("hots").alias("hots"), F.first("hot").alias("hot"))
    heads = common.written(heads.select("hid", "lead.n", F.col("lead.key").alias("lead"), "hots", "hot"), "heads")
    tokens = common.written(_prefixes(heads, num, den), "prefixes")
    # round one: few pairs of each list
    first = counted.where("n_cold > 0").groupBy("gid").agg(F.min("key").alias("lead"), F.count("*").alias("many"))
    lead = lambda c: first.select(F.col("gid").alias(c), F.col("lead").alias("k" + c))
    one = lambda pairs: pairs.groupBy("y").agg(F.min("x").alias("x"))
    pairs = one(group_pairs).join(lead("x"), "x").join(lead("y"), "y").select(F.col("kx").alias("a"), F.col("ky").alias("b"))
    pairs = pairs.union(classes.join(first.where("many > 1").select("gid", "lead"), "gid").select("lead", "key"))
    pairs = pairs.union(one(deep_pairs).select("x", "y"))
    pairs = common.written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = _verified(docs, classes, pairs, k, num, den)
    inside = tails.join(heads.select("hid", F.col("n").alias("least"), "lead"), "hid").where("key <> lead")
    links = links.union(inside.where((num + den) * F.col("hots") >= num * (F.col("n") + F.col("least"))).select("lead", "key"))
    # the text that the others of a list vary has the fewest shingles of its own
    fewest = tokens.groupBy("token").agg(F.min(F.struct(F.expr("n - rest").alias("own"), "n", "hid")).alias("lead"), F.count("*").alias("many")).where("many > 1")
    stars = tokens.join(fewest.select("token", "lead"), "token").where("lead.hid <> hid").groupBy("hid").agg(F.min("lead").alias("lead")).select(F.least("hid", "lead.hid").alias("x"), F.greatest("hid", "lead.hid").alias("y"))
    near_parts = _near_parts(heads, stars.distinct(), num, den)
    leads = lambda s: heads.select(F.col("hid").alias(s), F.col("lead").alias("lead_" + s))
    led = lambda pairs: pairs.join(leads("x"), "x").join(leads("y"), "y").select("lead_x", "lead_y")
    links = common.written(links.union(led(near_parts)), "links")
    parts = common.connected_components(links).withColumnRenamed("node", "key")
    # round two: what is left between components
    named = counted.join(parts, "key", "left").select("key", "gid", "n", "n_cold", F.coalesce("component", "key").alias("part"))
    named = common.written(named, "named")
    side = lambda s: named.where("n_cold > 0").select(F.col("gid").alias("g" + s), F.col("key").alias(s), F.col("n").alias("n" + s), F.col("part").alias("p" + s))
    many = named.where("n_cold > 0").groupBy("gid").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    ends = lambda c: many.select(F.col("gid").alias(c), F.col("lo").alias("lo" + c), F.col("hi").alias("hi" + c))
    more = group_pairs.join(ends("x"), "x").join(ends("y"), "y").where("lox <> loy or hix <> hiy or lox <> hix").select("x", "y")
    apart = (F.col("pa") != F.col("pb")) & (den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    left = more.join(side("a"), F.col("x") == F.col("ga")).join(side("b"), (F.col("y") == F.col("gb")) & apart).select("a", "b")
    # a group with a shingle that is not hot has `hot` classes at most
    mixed = many.where("lo <> hi").select("gid")
    inside = side("a").join(mixed, F.col("ga") == F.col("gid")).drop("gid")
    left = left.union(inside.join(side("b"), (F.col("ga") == F.col("gb")) & apart & (F.col("a") < F.col("b"))).select("a", "b"))
    ends = lambda c: named.select(F.col("key").alias(c), F.col("part").alias("p" + c))
    left = left.union(deep_pairs.join(ends("x"), "x").join(ends("y"), "y").where("px <> py").select("x", "y"))
    left = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    left = common.written(left, "pairs")
    new = links.limit(0)
    if not left.isEmpty():
        new = _verified(docs, classes, left, k, num, den)
    placed = tails.select("key", "hid").join(named.select("key", "part"), "key").groupBy("hid").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    across = common.written(_apart(tokens.join(placed, "hid"), num, den), "across")
    if not across.isEmpty():
        near_parts = near_parts.union(_near_parts(heads, across, num, den))
    # each set of a part goes to that least set of a near part which reaches the largest sets
    turned = near_parts.select("x", "y", "both").union(near_parts.select("y", "x", "both"))
    reach = turned.join(heads.select(F.col("hid").alias("y"), "n", "lead"), "y").select("x", F.floor((num + den) * F.col("both") / num - F.col("n")).alias("reach"), "lead")
    reach = reach.groupBy("x").agg(F.max(F.struct("reach", "lead")).alias("best"))
    new = new.union(led(near_parts)).union(tails.join(reach, F.col("hid") == F.col("x")).where("n <= best.reach").select("key", "best.lead"))
    new = common.written(new.distinct(), "links")
    if not new.isEmpty():
        links = links.union(new).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        parts = common.connected_components(links).withColumnRenamed("node", "key")
    whole = classes.select("key", "doc_id").join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = common.written(whole.join(least, "component").select("key", "component_id", "component"), "components")
    members = some.select("doc_id", "n", "key", "text_hash").join(whole, "key").select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("class_id"), "component_id", "text_hash", "component")
    members = members.union(sets.where("n = 0").select("doc_id", "n", F.lit(None).cast("long"), "doc_id", "text_hash", F.lit(None).cast("long")))
    return members, links


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents; as jaccard_join() says."""
    members, _ = jaccard_join(common.documents(spark, sf_dir))
    return members.select("doc_id", "n_shingles", "component_id")

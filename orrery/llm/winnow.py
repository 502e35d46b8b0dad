"""Document fingerprints by winnowing, in DataFrame functions only.

Grams have a rolling hash over blocks of four bytes: each block has a number,
and the hash of a gram is that of the gram one block before, shifted by one
bit, xor the number of the new block, without that of the old one. An array of
all of them is built by spans, each from those a few times shorter:
hash(ab) = hash(a) << |b| xor hash(b), where |b| counts blocks. (With blocks of
one byte the same takes half as long again.) Elements some places apart are
joined by zip_with over slices: looking them up by place in a lambda is dearer.
The least of each window is sought among the grams with a low hash.

A fingerprint is an array of long numbers, one for each chosen k-gram of UTF-8
bytes, by position: the upper half is the upper half of the gram's hash, the
lower half counts down with its byte position. So the least number of a window is
its least hash, the rightmost of equals. Any `grams + k - 1` bytes that two
texts share hold a gram that both fingerprints have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a gram, grams of a window; together they guarantee matches of K + WINDOW - 1 bytes.
K, WINDOW = 16, 64
#: Windows worked on at a time, so that a long text takes linear time.
CHUNK = 2048
#: Grams with a low hash that a window has on average.
LOW = 9
_LOW = 0xFFFFFFFF
#: Bits of a place in a chunk.
_PLACE_BITS = 20
_PLACES = (1 << _PLACE_BITS) - 1


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _paired(a: Column, b: Column, offset: int, join) -> Column:
    """join() of each element of a and the one of b at this offset from its place; both arrays end at the same place of the text."""
    n = F.greatest(F.size(b) - offset, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, offset + 1, n), join)


def block_size(k: int) -> int:
    """Bytes of a block: the largest of 4 to 1 that divides a gram."""
    return next(b for b in (4, 3, 2, 1) if k % b == 0)


def _hashes(part: Column, k: int) -> Column:
    """The hash of each gram of `part`."""
    block = block_size(k)
    a = F.transform(F.sequence(F.lit(1), F.octet_length(part) - block + 1), lambda p: F.xxhash64(F.substring(part, p, F.lit(block))))
    width = block
    while width < k:
        times = next(f for f in range(2, k + 1) if k // width % f == 0)
        shifted = (lambda w: lambda x, y: F.shiftleft(x, w).bitwiseXOR(y))(width // block)
        joined = (lambda w, t, step: lambda b: reduce(lambda u, j: _paired(u, b, w * j, step), range(1, t), b))(width, times, shifted)
        a = _let(a, joined)
        width *= times
    return a


def _numbered(hashes: Column, start: Column) -> Column:
    """Numbers of grams, the first at byte `start` of the text."""
    return F.transform(hashes, lambda x, i: x.bitwiseOR(F.lit(_LOW)) - start - i)


def _runs(a: Column) -> Column:
    """a without elements equal to the one before."""
    return F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))


def _window_minima(a: Column, grams: int) -> Column:
    """The least of each `grams` numbers in a row, by spans twice as long each, and each run of equal minima once."""
    width = 1
    while width < grams:
        longer = min(2 * width, grams)
        a = _let(a, (lambda offset: lambda b: _paired(b, b, offset, lambda x, y: F.least(x, y)))(longer - width))
        width = longer
    return _let(a, _runs)


def _ahead(x: Column, y: Column) -> Column:
    """Places from x to y, two numbers of _low()."""
    return x.bitwiseAND(F.lit(_PLACES)) - y.bitwiseAND(F.lit(_PLACES))


def _low(hashes: Column, bound: int) -> Column:
    """Those below `bound`, by place, as numbers: the upper half of the hash, then a place that counts down. Before and after them comes one less than all others, beyond the ends."""
    edge = lambda place: F.array(F.lit(_PLACES - (1 << 62)) - place)
    numbers = F.transform(hashes, lambda x, i: F.when(x < F.lit(bound), F.shiftright(x, 32 - _PLACE_BITS).bitwiseOR(F.lit(_PLACES)) - i - 1))
    return F.concat(edge(F.lit(0)), F.filter(numbers, lambda x: x.isNotNull()), edge(F.size(hashes) + 1))


def _peaks_cut(low: Column, grams: int) -> Column:
    """Numbers of _low() without those that are the least of no window.

    A number between two lesser neighbours no more than a window apart is in no
    window without one of them. Rounds that drop those end when nothing is
    left to drop; between the nearest lesser numbers of one that is not chosen
    there are fewer than `grams`, and each round drops the largest of them, so
    `grams` rounds are enough.
    """

    def kept(c: Column) -> Column:
        inner = F.size(c) - 2
        some = lambda after: F.filter(F.slice(c, 2, inner), lambda x, i: (F.get(c, i) > x) | (F.get(after, i) > x) | (_ahead(F.get(c, i), F.get(after, i)) > grams))
        return F.concat(F.slice(c, 1, 1), _let(F.slice(c, 3, inner), some), F.slice(c, -1, 1))

    def again(state: Column, _: Column) -> Column:
        step = _let(kept(state["now"]), lambda after: F.struct(after.alias("now"), (F.size(after) == F.size(state["now"])).alias("done")))
        return F.when(state["done"], state).otherwise(step)

    return F.aggregate(F.sequence(F.lit(1), F.lit(grams)), F.struct(low.alias("now"), F.lit(False).alias("done")), again, lambda state: state["now"])


def _chosen(hashes: Column, start: Column, grams: int) -> Column:
    """The least gram of each window, once each.

    Only grams with a low hash are looked at, LOW a window on average, unless
    some window has none of them: then all grams are.
    """
    every = _window_minima(_numbered(hashes, start), grams)
    if grams <= LOW or CHUNK + grams >= _PLACES:
        return every

    def of(c: Column) -> Column:
        empty = F.exists(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: _ahead(x, y) > grams), lambda x: x)
        number = lambda x: F.shiftleft(F.shiftright(x, _PLACE_BITS), 32).bitwiseOR(F.lit(_LOW)) - start - (_PLACES - 1) + x.bitwiseAND(F.lit(_PLACES))
        return F.when(empty, every).otherwise(F.transform(F.slice(c, 2, F.size(c) - 2), number))

    return _let(_peaks_cut(_low(hashes, (LOW << 64) // grams - (1 << 63)), grams), of)


def windowed(text: Column, k: int = K, grams: int = WINDOW) -> Column:
    """Chosen grams of all whole windows of a binary text; none if it is shorter than one. k is 1 to 32: each block of a gram reaches the upper half of its hash."""
    if not 1 <= k <= 32:
        raise ValueError("grams have 1 to 32 bytes")
    span = k + grams - 1

    def chunk(b: Column, start: Column) -> Column:
        part = F.substring(b, (start + 1).cast("int"), F.lit(CHUNK + span - 1))
        return _let(_let(part, lambda p: _hashes(p, k)), lambda a: _chosen(a, start, grams))

    def whole(b: Column) -> Column:
        starts = F.sequence(F.lit(0).cast("long"), (F.octet_length(b) - span).cast("long"), F.lit(CHUNK).cast("long"))
        return _let(F.flatten(F.transform(starts, lambda s: chunk(b, s))), _runs)

    return _let(text, lambda b: F.when(F.octet_length(b) >= span, whole(b)).otherwise(F.array().cast("array<bigint>")))


def winnowed(text: Column, k: int = K, grams: int = WINDOW) -> Column:
    """Fingerprint of a binary text. One shorter than a window gives its least gram, one shorter than a gram its hash, an empty one nothing."""
    span, zero = k + grams - 1, F.lit(0).cast("long")

    def of(b: Column) -> Column:
        n = F.octet_length(b)
        short = F.array(F.array_min(_numbered(_hashes(b, k), zero)))
        tiny = F.array(F.xxhash64(b).bitwiseOR(F.lit(_LOW)))
        return F.when(n >= span, windowed(b, k, grams)).when(n >= k, short).when(n > 0, tiny).otherwise(F.array().cast("array<bigint>"))

    return _let(text, of)


def position(x: Column) -> Column:
    return _LOW - x.bitwiseAND(F.lit(_LOW))


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 32).cast("int")))


def shown(fp: Column) -> Column:
    """The fingerprint as text: hash and byte position of each chosen gram, in hexadecimal."""
    return F.array_join(F.transform(fp, lambda x: F.concat_ws("@", F.hex(F.shiftrightunsigned(x, 32)), F.hex(position(x)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def within(fp: Column, last: Column, grams: int = WINDOW) -> Column:
    """Of the windows' fingerprint, what the windows that start at `last` or before choose.

    A gram is first chosen by the window that it enters, if it is less than
    the one before, else by the first window without the one before.
    """
    first = lambda x, i: F.when(i == 0, F.lit(0).cast("long")).when(x < F.get(fp, i - 1), position(x) - grams + 1).otherwise(position(F.get(fp, i - 1)) + 1)
    return F.filter(fp, lambda x, i: first(x, i) <= last)


def neighbours(ids: DataFrame, parts: int) -> DataFrame:
    """(did, h, n_chars, next_did, next_h) for distinct (did, h): the next document by descending did, after the last the first.

    Ids are dealt by range; only each range's first row, one for a range, is
    looked at together.
    """
    order = [F.col("did").desc(), F.col("h").desc()]
    rows = ids.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id())
    rows = common.written(rows, "ranges")
    own = Window.partitionBy("pid").orderBy(*order)
    heads = rows.groupBy("pid").agg(F.max(F.struct("did", "h")).alias("head"))
    over = Window.orderBy("pid")
    around = heads.withColumn("after", F.lead("head").over(over))
    top = heads.agg(F.max("head").alias("top"))
    around = around.crossJoin(F.broadcast(top)).select("pid", F.coalesce("after", "top").alias("after"))  # one row
    rows = rows.withColumn("next", F.lead(F.struct("did", "h")).over(own)).join(F.broadcast(around), "pid")  # a row for each range
    following = F.coalesce("next", "after")
    return rows.select("did", "h", "n_chars", following["did"].alias("next_did"), following["h"].alias("next_h"))


def edited_fingerprints(docs: DataFrame, k: int = K, grams: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text has its last third (whole code points, rounded down)
    replaced by as many first code points of the next document by descending
    doc_id. Its fingerprint is put together from what windows inside the kept
    part and inside the taken part choose, and those over the seam.

    Null texts count as empty. A null doc_id comes after all others. Rows
    equal in doc_id and text are one document in the order and get one result;
    other rows of one doc_id are ordered by a hash of the text. A lone
    document is its own next. Other columns are not read. An empty table gives
    no rows.
    """
    span = k + grams - 1
    did, back = common.ordered_ids(docs, null_first=True)
    rows = docs.select(did.alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("did", F.xxhash64("text").alias("h"), "text")
    ids = rows.select("did", "h", F.length("text").cast("long").alias("n_chars"))
    order = common.written(neighbours(ids.distinct(), common.partitions(docs.sparkSession)), "order")
    rows = rows.withColumn("fp", winnowed(F.col("text").cast("binary"), k, grams))
    third = order.select(F.col("next_did").alias("did"), F.col("next_h").alias("h"), F.col("did").alias("to_did"), F.col("h").alias("to_h"), F.expr("cast(n_chars div 3 as int)").alias("third"))
    sent = rows.join(third.hint("merge"), ["did", "h"])
    sent = sent.withColumn("taken", F.expr("substring(text, 1, third)").cast("binary")).select(
        F.col("to_did").alias("did"),
        F.col("to_h").alias("h"),
        "taken",
        F.when(F.octet_length("text") >= span, within(F.col("fp"), F.octet_length("taken") - span, grams)).otherwise(F.array().cast("array<bigint>")).alias("taken_fp"),
        hashes(F.col("fp")).alias("next_hashes"),
    )
    if ids.count() > order.count():
        sent = sent.dropDuplicates(["did", "h"])
    both = rows.join(sent.hint("merge"), ["did", "h"]).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("head", F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))").cast("binary"))
    at = F.octet_length("head")
    base = F.greatest(at - span + 1, F.lit(0))
    seam = F.concat(F.expr(f"substring(head, cast(greatest(octet_length(head) - {span - 1}, 0) + 1 as int), {span - 1})"), F.expr(f"substring(taken, 1, {span - 1})"))
    own = F.when(F.octet_length("text") >= span, within(F.col("fp"), at - span, grams)).otherwise(F.array().cast("array<bigint>"))
    joined = F.concat(own, F.transform(windowed(seam, k, grams), lambda x: x - base), F.transform("taken_fp", lambda x: x - at))
    edited = F.concat("head", "taken")
    edited_fp = F.when(at + F.octet_length("taken") < span, winnowed(edited, k, grams)).otherwise(_let(joined, _runs))
    both = both.withColumns({"edited_fp": edited_fp, "edited_sha256": F.sha2(edited, 256), "own": hashes(F.col("fp"))})
    return both.select(
        back(F.col("did")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_fp"))).alias("near_edited"),
        likeness(F.col("own"), F.col("next_hashes")).alias("near_next"),
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; as edited_fingerprints() says."""
    return edited_fingerprints(common.documents(spark, sf_dir))

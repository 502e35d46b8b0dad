"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

The count table is partitioned by the n-grams' hashes. Documents are dealt to
chunks; each chunk's distinct n-grams, with its own counts, go to their
partitions once, packed; each partition sums them up over all chunks and sends
every chunk the totals of what it asked for; the chunk joins them to the
n-grams of its documents and sums up by document. A frequent n-gram so costs
one entry a chunk, however often it occurs, and there are no more rows than
distinct n-grams of chunks, and no more than chunks times partitions. Trigrams
and longer ones are asked for in several passes, each over a range of the hashes,
so that only one pass's questions are on disk at a time; the answers, a byte or
so for an n-gram, are written to the shared folder. Rows equal
in id and text are one entry with a number of copies, counted before the
shuffle, so that no chunk gets them all.

N-grams are told apart by 64-bit hashes: two that share one count as one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textpack
from .jaccard import MOST_BROADCAST, _dealt, _gathered

BACKOFF = 0.4
#: Bytes of text in a chunk, and in the chunks that ask one partition, about.
CHUNK_BYTES = 5 << 20


def _chunk(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all documents of a chunk: document of each n-gram, its hash, where each order starts, and words a document. Order 0 is the empty context, once a word."""
    batch = table.select(["text"]).combine_chunks().to_batches()
    buf, offs = textpack.packed(batch[0].column("text")) if batch else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    docs, grams = [[] for _ in range(order + 1)], [[] for _ in range(order + 1)]
    count = np.zeros(len(offs) - 1, np.int64)
    i = 0
    while i < len(offs) - 1:  # word by word tables of a few documents at a time
        j = min(len(offs) - 1, max(i + 1, int(np.searchsorted(offs, offs[i] + (1 << 20), "right")) - 1))
        h, at = textpack.words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        n = np.diff(at)
        count[i:j] = n
        doc = np.repeat(np.arange(i, j), n)
        docs[0].append(doc)
        grams[0].append(np.zeros(len(h), np.uint64))
        for g in range(1, order + 1):
            own = textpack.ngrams(h, g)
            same = doc[: len(own)] == doc[len(doc) - len(own) :] if len(own) else np.zeros(0, bool)
            docs[g].append(doc[: len(own)][same])
            grams[g].append(own[same])
        i = j
    empty_d, empty_h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    docs, grams = [np.concatenate([*x, empty_d]) for x in docs], [np.concatenate([*x, empty_h]) for x in grams]
    return np.concatenate(docs), np.concatenate(grams), [len(x) for x in docs], count


def _packed_counts(n: np.ndarray) -> bytes:
    """One byte for each count; 255 marks those that follow in full, in order."""
    large = n >= 255
    return np.where(large, 255, n).astype("u1").tobytes() + n[large].astype("<u8").tobytes()


def _unpacked_counts(data: bytes, many: int) -> np.ndarray:
    n = np.frombuffer(data, "u1", many).astype(np.float64)
    n[n == 255] = np.frombuffer(data, "<u8", offset=many)
    return n


def _bucket(h: np.ndarray, buckets: int, passes: int) -> np.ndarray:
    """The partition of each hash; each pass, a range of the hashes, has `buckets` of its own."""
    starts = np.array([(p << 64) // passes for p in range(passes)], np.uint64)
    return (textpack.mix(h) % np.uint64(buckets)).astype(np.int64) + buckets * (np.searchsorted(starts, h, "right") - 1)


def _asked(table: pa.Table, order: int, buckets: int, passes: int, now: int) -> pa.Table:
    doc, grams, _, _ = _chunk(table, order)
    if passes > 1:
        mine = (grams >= np.uint64((now << 64) // passes)) & (grams <= np.uint64(((now + 1 << 64) // passes) - 1))
        doc, grams = doc[mine], grams[mine]
    copies = table.column("copies").to_numpy()
    if (copies > 1).any():
        h, inverse = np.unique(grams, return_inverse=True)
        n = np.bincount(inverse, copies[doc], len(h))
    else:
        h, n = np.unique(grams, return_counts=True)
    out = _dealt(_bucket(h, buckets, passes), [h, n.astype("<u8")], ["bucket", "h", "n"])
    out = out.set_column(2, "n", pa.array([_packed_counts(np.frombuffer(x, "<u8")) for x in out.column(2).to_pylist()], pa.binary()))
    chunk = pa.array(np.full(len(out), table.column("chunk")[0].as_py()), pa.int64())
    return pa.table([out.column(0), chunk, out.column(1), out.column(2)], names=["bucket", "chunk", "h", "n"])


def _answered(table: pa.Table) -> pa.Table:
    """For each chunk, the total of each n-gram that it asked for, in its order."""
    h = _gathered(table, "h", "<u8")
    n = np.concatenate([_unpacked_counts(x, len(y) // 8) for x, y in zip(table.column("n").to_pylist(), table.column("h").to_pylist(), strict=True)])
    _, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, n)[inverse]
    ends = np.cumsum([len(x) // 8 for x in table.column("h").to_pylist()])
    totals = pa.array([_packed_counts(x) for x in np.split(total, ends[:-1])], pa.binary())
    return pa.table([table.column("chunk"), table.column("bucket"), totals], names=["chunk", "bucket", "totals"])


def _scored(table: pa.Table, answers: pa.Table, order: int, buckets: int, passes: int, own: bool) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("backed_off", pa.int64()), ("copies", pa.int64())])
    if not len(table):
        return schema.empty_table()
    doc, grams, sizes, count = _chunk(table, order)
    h, inverse = np.unique(grams, return_inverse=True)
    bucket = _bucket(h, buckets, passes)
    total = np.zeros(len(h))
    by = np.argsort(bucket, kind="stable")  # as _dealt orders what a chunk asks for
    at = np.searchsorted(bucket[by], np.arange(buckets * passes + 1))
    for b, totals in zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True):
        total[by[at[b] : at[b + 1]]] = _unpacked_counts(totals, at[b + 1] - at[b])
    seen = total[inverse]
    if own:  # without the document's own counts
        pair = textpack.mix(grams + textpack.mix(doc.astype(np.uint64) + np.uint64(1)))
        _, back, many = np.unique(pair, return_inverse=True, return_counts=True)
        seen = seen - many[back]
    first = np.cumsum([0, *sizes])
    counts = [seen[first[g] : first[g + 1]] for g in range(order + 1)]
    starts = np.concatenate(([0], np.cumsum(count)))
    word = starts[doc[: sizes[0]]]  # of each word, its document's first
    place = np.arange(sizes[0]) - word
    # n-gram g that ends at a word: by document, those of order g start max(count - g + 1, 0) a document
    value = np.full(sizes[0], -1.0)
    level = np.zeros(sizes[0], np.int64)
    for g in range(order, 0, -1):
        ahead = np.concatenate(([0], np.cumsum(np.maximum(count - g + 1, 0))))
        context = np.concatenate(([0], np.cumsum(np.maximum(count - g + 2, 0)))) if g > 1 else starts
        open_ = np.flatnonzero((value < 0) & (place >= g - 1))
        d = doc[open_]
        c = counts[g][ahead[d] + place[open_] - (g - 1)]
        base = counts[g - 1][(context[d] + place[open_] - (g - 1)) if g > 1 else open_]
        hit = (c > 0) & (base > 0)
        value[open_[hit]] = c[hit] / base[hit]
        level[open_[hit]] = np.minimum(place[open_[hit]], order - 1) - (g - 1)
    unknown = value < 0
    value[unknown] = 1 / (counts[0][unknown] + 1)
    level[unknown] = np.minimum(place[unknown], order - 1)
    logs = np.log10(value) + level * np.log10(BACKOFF)
    return pa.table([table.column("doc_id").combine_chunks(), pa.array(count), pa.array(np.bincount(doc[: sizes[0]], logs, len(count))), pa.array(np.bincount(doc[: sizes[0]], level > 0, len(count)).astype(np.int64)), table.column("copies").combine_chunks()], schema=schema)


def _counted_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, copies) of the different rows. Only the text of rows that occur more than once is grouped, within tasks first."""
    rows = docs.withColumn("hash", F.xxhash64("text"))
    often = rows.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.col("hash").alias("h"))
    often = common.written(often, "repeated")
    many = often.count()
    if not many:
        return docs.withColumn("copies", F.lit(1).cast("long"))
    often = F.broadcast(often) if many <= MOST_BROADCAST else often
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h"))
    once = rows.join(often, same, "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    return once.union(rows.join(often, same, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies")))


def score_documents(docs: DataFrame, order: int = 2, leave_out_own: bool = True) -> DataFrame:
    """doc_id, n_words, score and backed_off of every document.

    score sums log10 S(word | words before) over the text's words (A-Z in lower
    case): count(context word) / count(context) if the n-gram occurs, else 0.4
    times the score with a context one word shorter; a word that occurs nowhere
    has 1 / (words + 1). Counts are those of all documents, by default without
    the scored document's own, so that a text is judged by the others.
    backed_off counts words whose full context had to be shortened.

    Null and empty texts have no words and score 0. Rows are scored one by one:
    repeated rows count each other, null ids and shared ids too; rows equal in
    id and text are scored once and given out as often as they occur. A long
    text is in one chunk, whole. Other columns are not read. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    grams = size * (order + 1) // 3  # longer n-grams fill a chunk with less text
    chunks = max(common.partitions(spark, 2), grams // CHUNK_BYTES)
    passes = order if order > 2 else 1
    buckets = -(-max(common.partitions(spark), grams // (4 * CHUNK_BYTES)) // passes)  # of a pass; a row goes from each chunk to each of all passes
    rows = _counted_rows(docs.select("doc_id", text.alias("text")))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def answered(now: int) -> DataFrame:
        asked = rows.groupBy("chunk").applyInArrow(lambda t: _asked(t, order, buckets, passes, now), "bucket int, chunk long, h binary, n binary")
        return asked.groupBy("bucket").applyInArrow(_answered, "chunk long, bucket int, totals binary")

    if passes == 1:
        answers = answered(0)
    else:
        answers = reduce(DataFrame.union, [common.written(answered(now), "totals", freed=True) for now in range(passes)])
    joined = rows.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    scored = joined.applyInArrow(lambda t, a: _scored(_in_order(t) if len(t) else t, a, order, buckets, passes, leave_out_own), "doc_id long, n_words long, score double, backed_off long, copies long")
    return common.repeated(scored, "copies")


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("doc_id")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of all documents, to four digits; as score_documents() says."""
    out = score_documents(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"), "backed_off")


def op6_lm_scoring_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all documents, to four digits; as score_documents() says."""
    out = score_documents(common.documents(spark, sf_dir), order=3)
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"), "backed_off")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
p AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM w),
c1 AS (SELECT word, count(*) AS n FROM p GROUP BY 1), o1 AS (SELECT doc_id, word, count(*) AS n FROM p GROUP BY 1, 2),
c2 AS (SELECT prev, word, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY 1, 2),
o2 AS (SELECT doc_id, prev, word, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT count(*) AS n FROM p), s AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1),
x AS (SELECT p.doc_id, p.prev, t.n - s.n AS total, c1.n - o1.n AS one, c2.n - o2.n AS two, b.n - ob.n AS before
 FROM p CROSS JOIN t JOIN s USING (doc_id) JOIN c1 ON c1.word = p.word JOIN o1 ON o1.doc_id = p.doc_id AND o1.word = p.word
 LEFT JOIN c2 ON c2.prev = p.prev AND c2.word = p.word LEFT JOIN o2 ON o2.doc_id = p.doc_id AND o2.prev = p.prev AND o2.word = p.word
 LEFT JOIN c1 b ON b.word = p.prev LEFT JOIN o1 ob ON ob.doc_id = p.doc_id AND ob.word = p.prev),
v AS (SELECT doc_id, CASE WHEN two > 0 AND before > 0 THEN log10(two / before)
 WHEN one > 0 AND total > 0 THEN log10(one / total) + CASE WHEN prev IS NULL THEN 0 ELSE log10(0.4) END
 ELSE log10(1.0 / (total + 1)) + CASE WHEN prev IS NULL THEN 0 ELSE log10(0.4) END END AS l,
 CASE WHEN prev IS NOT NULL AND NOT coalesce(two > 0 AND before > 0, FALSE) THEN 1 ELSE 0 END AS b FROM x)
SELECT d.doc_id, coalesce(count(v.l), 0) AS n_words, round(coalesce(sum(v.l), 0), 4) AS score, CAST(coalesce(sum(v.b), 0) AS BIGINT) AS backed_off
FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id
"""

OP6_ORDER3_SQL = r"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
p AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev, lag(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS far FROM w),
c1 AS (SELECT word, count(*) AS n FROM p GROUP BY 1), o1 AS (SELECT doc_id, word, count(*) AS n FROM p GROUP BY 1, 2),
c2 AS (SELECT prev, word, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY 1, 2),
o2 AS (SELECT doc_id, prev, word, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY 1, 2, 3),
c3 AS (SELECT far, prev, word, count(*) AS n FROM p WHERE far IS NOT NULL GROUP BY 1, 2, 3),
o3 AS (SELECT doc_id, far, prev, word, count(*) AS n FROM p WHERE far IS NOT NULL GROUP BY 1, 2, 3, 4),
t AS (SELECT count(*) AS n FROM p), s AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1),
x AS (SELECT p.doc_id, CASE WHEN p.prev IS NULL THEN 0 WHEN p.far IS NULL THEN 1 ELSE 2 END AS most, t.n - s.n AS total,
 c1.n - o1.n AS one, c2.n - o2.n AS two, b.n - ob.n AS before, c3.n - o3.n AS three, e.n - oe.n AS ahead
 FROM p CROSS JOIN t JOIN s USING (doc_id) JOIN c1 ON c1.word = p.word JOIN o1 ON o1.doc_id = p.doc_id AND o1.word = p.word
 LEFT JOIN c2 ON c2.prev = p.prev AND c2.word = p.word LEFT JOIN o2 ON o2.doc_id = p.doc_id AND o2.prev = p.prev AND o2.word = p.word
 LEFT JOIN c1 b ON b.word = p.prev LEFT JOIN o1 ob ON ob.doc_id = p.doc_id AND ob.word = p.prev
 LEFT JOIN c3 ON c3.far = p.far AND c3.prev = p.prev AND c3.word = p.word
 LEFT JOIN o3 ON o3.doc_id = p.doc_id AND o3.far = p.far AND o3.prev = p.prev AND o3.word = p.word
 LEFT JOIN c2 e ON e.prev = p.far AND e.word = p.prev LEFT JOIN o2 oe ON oe.doc_id = p.doc_id AND oe.prev = p.far AND oe.word = p.prev),
y AS (SELECT *, CASE WHEN three > 0 AND ahead > 0 THEN 2 WHEN two > 0 AND before > 0 THEN 1 ELSE 0 END AS hit FROM x),
v AS (SELECT doc_id, (most - hit) * log10(0.4) + CASE WHEN hit = 2 THEN log10(three / ahead) WHEN hit = 1 THEN log10(two / before)
 WHEN one > 0 AND total > 0 THEN log10(one / total) ELSE log10(1.0 / (total + 1)) END AS l, CASE WHEN hit < most THEN 1 ELSE 0 END AS b FROM y)
SELECT d.doc_id, coalesce(count(v.l), 0) AS n_words, round(coalesce(sum(v.l), 0), 4) AS score, CAST(coalesce(sum(v.b), 0) AS BIGINT) AS backed_off
FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id
"""

"""SQL for the queries whose results SQL can express on small tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Pairs by an inverted index of shingles, components by transitive closure.
JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
 GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) m ON m.id = d.doc_id
"""

#: Every window of 100 bytes, as hexadecimal digits; all but a string's first go.
REPEATS = """
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
b AS (SELECT doc_id, hx, CAST(length(hx) // 2 AS BIGINT) AS n FROM h),
v AS (SELECT doc_id, i, hash(substr(hx, 2 * i - 1, 200)) AS k FROM (SELECT doc_id, hx, unnest(range(1, n - 98)) AS i FROM b WHERE n >= 100)),
g AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
m AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM g)),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM m GROUP BY 1, 2),
q AS (SELECT s.doc_id, run, a, z, substr(hx, 2 * coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY run), 1) - 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY run), 1))) AS piece FROM s JOIN b USING (doc_id)),
t AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS removed, count(*) AS spans, string_agg(piece, '' ORDER BY run) AS head, max(z) AS z FROM q GROUP BY 1)
SELECT b.doc_id, b.n AS n_bytes, coalesce(t.removed, 0) AS n_removed, coalesce(t.spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN t.doc_id IS NULL THEN hx ELSE t.head || substr(hx, 2 * t.z - 1) END)) AS kept_sha256 FROM b LEFT JOIN t USING (doc_id)
"""

#: All pairs of one label.
LATTICE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
 WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT vec_id, coalesce(l.n, 0) AS n_links, m.c AS component_id, vec_id = m.c AS kept FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY 1) l ON l.a = vec_id JOIN m ON m.id = vec_id
"""


def crc_table() -> list[int]:
    """The 256 remainders of the reflected CRC-32 polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def sharding(n_shards: int = 8, seed: int = 17) -> str:
    """CRC-32 byte by byte, then the ranks and the cut as plain windows."""
    table = "[" + ", ".join(f"CAST({x} AS BIGINT)" for x in crc_table()) + "]"
    digit = lambda at: f"strpos('0123456789ABCDEF', substr(hx, {at}, 1)) - 1"
    number = lambda text: f"CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) / 4294967296.0"
    return f"""
WITH b AS MATERIALIZED (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS hx FROM documents),
y AS (SELECT doc_id, i, ({digit('2 * i - 1')}) * 16 + {digit('2 * i')} AS byte FROM (SELECT doc_id, hx, unnest(range(1, length(hx) // 2 + 1)) AS i FROM b)),
c AS (SELECT doc_id, xor(list_reduce(list(byte ORDER BY i), lambda c, x: xor(c >> 8, list_extract({table}, xor(c & 255, x) + 1)), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM y GROUP BY 1),
d AS (SELECT b.doc_id, source, CAST(length(hx) // 2 + 1 AS BIGINT) AS size, coalesce(crc, 0) AS text_crc32, '=' || source AS s FROM b LEFT JOIN c USING (doc_id)),
k AS (SELECT *, coalesce(s, '') AS g, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32) AS k FROM d),
f AS (SELECT *, (row_number() OVER (PARTITION BY g ORDER BY k) - {number('g')}) / count(*) OVER (PARTITION BY g) AS f, count(*) OVER () AS n FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY f, k, g) - 1 AS p FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * {n_shards} // n AS INTEGER) AS shard, p - (p * {n_shards} // n * n + {n_shards - 1}) // {n_shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p
"""

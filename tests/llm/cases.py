"""Small tables with every awkward case, and brute-force versions of the operators."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = {"shard": "1", "slot": "2", "weight": "3", "probability": "4", "sampled": "5", "ids": "6", "n": "7", "key": "8", "cls": "9", "did": "10", "chunk": "11", "label": "12", "score": "13", "__tokens": "14", "__lang": "15", "__s": "16", "__k": "17", "__did": "18", "words": "19", "_did": "20", "_s": "21", "s": "22", "topic_": "23"}


def texts(seed=1, many=60, base=None):
    """Prose with copies, near copies, shared passages and odd texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéßñ") for _ in range(rnd.randint(1, 7))) for _ in range(150)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    out = [None, "", " \t\n", "x", "A b", "a B", "你好 😀", "aaaa" * 100, "ab " * 300]
    shared = prose(60)
    whole = [prose(rnd.randint(1, 120)) for _ in range(many)]
    out += whole
    for t in whole[: many // 3]:
        w = t.split(" ")
        out.append(t)
        w[rnd.randrange(len(w))] = "edit"
        out.append(" ".join(w))
        out.append(prose(10) + " " + shared + "\n" + prose(12))
    out += [shared.replace("a", "A"), whole[0] + " " + whole[0], prose(4000)]
    return out


def documents(spark, rows=None, clash=True):
    rows = texts() if rows is None else rows
    data = [(i * 3, t, None if i % 9 == 4 else ["en", "de", "fr", "es"][i % 4], None if i % 11 == 5 else f"src{0 if i % 3 else i % 20}", len(t or "")) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    if not clash:
        return df
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    """Least id reachable, by pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def removed(docs, least=100):
    """(bytes, removed, spans, kept) of each id."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for j in range(len(b) - least + 1):
            w = b[j : j + least]
            if w in seen:
                cover[j : j + least] = b"\1" * least
            seen.add(w)
        spans = sum(1 for j in range(len(b)) if cover[j] and (j == 0 or not cover[j - 1]))
        out[i] = (len(b), sum(cover), spans, bytes(x for x, c in zip(b, cover) if not c))
    return out

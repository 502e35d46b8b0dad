"""Removal of repeated passages, by maximal repeats of a sampled enhanced suffix array.

A passage of `least` bytes that occurs twice contains, at the same place in
both, a byte gram that is the least (by hash, rightmost of equals) of some
window inside it. Only suffixes that start at such *anchors* are sorted: a few
of a hundred positions. Anchors that occur once are dropped by their hash;
the others, with the bytes before and after that a passage over them can
cover, are dealt by hash to tasks. Each task sorts the suffixes of an anchor,
scans their common-prefix lengths with a stack to get the tree of prefix
intervals, and inside each interval does the same with what stands to the
left: an interval whose left extensions differ is a maximal repeat, with all
its occurrences. Every occurrence but the first covers bytes to remove.

Equal texts are one class, of which only the first is searched. Equal contexts
of an anchor are merged in the task that reads them, before any shuffle. An
anchor in very many classes is split: each window of `least` bytes over it, a
leaf of its tree, is a group of its own, of which each task ships the first.
Windows are told apart by 128 bits of hash, everything else by its bytes. An
anchor that is frequent among the documents of one task is known to be split
before any of its postings is shipped.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textpack
from .jaccard import _dealt, _gathered

#: Bytes of an anchor.
GRAM = 32
#: An anchor in more classes than this is split into windows. LOCAL: or in more than this share of it in one task's chunk of CHUNK slices of text.
HOT, LOCAL, CHUNK = 2000, 16, 16
_LAST = (1 << 24) - 1
_SEGMENT = 1 << 22


def anchors(buf: np.ndarray, offs: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows of `least` bytes that lie in one document."""
    window, out = least - gram + 1, []
    ends = np.repeat(offs[1:], np.diff(offs))  # of the document that a byte is in
    for s in range(0, max(len(buf) - least + 1, 0), _SEGMENT):
        part = buf[s : s + _SEGMENT + least - 1]
        total = textpack.prefix_hash(part)
        h = textpack.mix((total[gram:] - total[:-gram]) * textpack.powers(len(part))[1][: len(part) - gram + 1])
        key = (h & ~np.uint64(_LAST)) | (np.uint64(_LAST) - np.arange(len(h), dtype=np.uint64))
        low, width = key, 1
        while 2 * width <= window:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if width < window:
            low = np.minimum(low[: len(key) - window + 1], low[window - width :])
        start = np.arange(len(low)) + s
        at = _LAST - (low[start + least <= ends[start]] & np.uint64(_LAST)).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
        out.append((at + s, h[at]))
    pos, h = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, d) for i, d in ((0, np.int64), (1, np.uint64)))
    keep = np.concatenate(([True], pos[1:] != pos[:-1])) if len(pos) else np.zeros(0, bool)
    return pos[keep], h[keep]


def _anchor_postings(docs: DataFrame, gram: int, least: int, buckets: int, parts: int, hot: int) -> DataFrame:
    """Kind 0: (bucket, h, cls, flag), packed by hash of the anchor; flag 1 if one text has it more than once, 2 if it is hot. Kind 1: hot anchors of one chunk, packed by class."""
    names, most = ["kind", "bucket", "h", "cls", "flag"], max(1, hot // LOCAL)

    def dealt(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, cls, flag = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((cls, h))
        h, cls, flag = h[order], cls[order], flag[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]))))
        h, cls, flag = h[new], cls[new], np.maximum.reduceat(flag, new)
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(start, len(h)))
        often = np.repeat(size > most, size)
        flag[often] = 2
        ship = ~often
        ship[start] = True  # one posting tells the other tasks
        yield _dealt((textpack.mix(h[ship]) % np.uint64(buckets)).astype(np.int64), [x[ship] for x in (h, cls, flag)], names, 0)
        if often.any():
            own = cls[often]
            yield _dealt((textpack.mix(own.view(np.uint64)) % np.uint64(parts)).astype(np.int64), [h[often], own, flag[often]], names, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part, buf, offs in textpack.slices(batch, "text"):
                pos, h = anchors(buf, offs, gram, least)
                if not len(pos):
                    continue
                cls = part.column("cls").to_numpy()
                first = np.zeros(len(cls), bool)
                first[np.unique(cls, return_index=True)[1]] = True
                doc = np.searchsorted(offs, pos, "right") - 1
                pos, h, doc = pos[first[doc]], h[first[doc]], doc[first[doc]]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
                twice = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
                held.append((h[new], cls[doc[new]], twice.astype(np.int8)))
                if len(held) >= CHUNK:
                    yield from dealt(held)
                    held = []
        if held:
            yield from dealt(held)

    return docs.select("cls", "text").mapInArrow(run, "kind int, bucket int, h binary, cls binary, flag binary")


def _repeated(table: pa.Table, parts: int, hot: int) -> pa.Table:
    """(part, h, cls, hot) of the anchors that occur more than once, packed by class."""
    names, place = ["part", "h", "cls", "hot"], lambda cls: (textpack.mix(cls.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    h, cls, flag = (_gathered(table, c, t) for c, t in (("h", "<u8"), ("cls", "<i8"), ("flag", "i1")))
    if table.column("kind")[0].as_py() == 1:
        return pa.Table.from_batches([_dealt(place(cls), [h, cls, flag > 0], names)])
    order = np.lexsort((cls, h))
    h, cls, flag = h[order], cls[order], flag[order]
    cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]))))
    flag = np.maximum.reduceat(flag, cut)
    h, cls = h[cut], cls[cut]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size, top = np.diff(np.append(start, len(h))), np.maximum.reduceat(flag, start)
    often = (size > 1) | (top > 0)
    keep, many = np.repeat(often, size), np.repeat((size > hot) | (top == 2), size)
    h, cls, many = h[keep], cls[keep], many[keep]
    return pa.Table.from_batches([_dealt(place(cls), [h, cls, many], names)])


def _by_class(table: pa.Table) -> pa.Table:
    h, cls, hot = (_gathered(table, c, t) for c, t in (("h", "<u8"), ("cls", "<i8"), ("hot", "?")))
    order = np.lexsort((h, cls))
    h, cls, hot = h[order], cls[order], hot[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]))))
    h, cls, hot = h[new], cls[new], np.logical_or.reduceat(hot, new)
    cut = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    ends = np.append(cut[1:], len(cls))
    pick = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())
    return pa.table([pa.array(cls[cut]), pick(h), pick(hot)], names=["cls", "h", "hot"])


_SENT = ["kind", "bucket", "h", "did", "cls", "pos", "left", "right", "context"]
_SECOND = textpack._random(256, 13)


def _hash_rows(m: np.ndarray) -> np.ndarray:
    m = np.ascontiguousarray(m).view("<u8")
    steps = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, m.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return textpack.mix((textpack.mix(m) * steps).sum(1, dtype=np.uint64))


def _contexts(staged: DataFrame, gram: int, least: int, buckets: int, all_of_them: bool = False) -> DataFrame:
    """Kind 0: repeated anchors with their contexts. Kind 1: windows over hot anchors, `left` their second hash. Kind 2: occurrences that a task found on its own, unless all_of_them are shipped."""
    side = least - gram
    width = -(-(side + least) // 8) * 8

    def local(did, cls, start, end, group) -> pa.RecordBatch:
        """did in place of h, the group's hash: packed by document."""
        none = np.zeros(len(did), np.int8)
        return _dealt((textpack.mix(cls.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), [group, did, cls, start, end, none, none], _SENT, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in textpack.slices(batch, "text"):
                pos, h = anchors(buf, offs, gram, least)
                dids, clss = (part.column(c).to_numpy() for c in ("did", "cls"))
                doc = np.searchsorted(offs, pos, "right") - 1
                cut = np.searchsorted(doc, np.arange(len(dids) + 1))
                keep, hot = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
                for d, (known, flags) in enumerate(zip(part.column("h").to_pylist(), part.column("hot").to_pylist(), strict=True)):
                    known, own = np.frombuffer(known, "<u8"), h[cut[d] : cut[d + 1]]
                    i = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    keep[cut[d] : cut[d + 1]] = known[i] == own
                    hot[cut[d] : cut[d + 1]] = np.frombuffer(flags, "?")[i]
                hot &= keep
                left, right = np.minimum(pos - offs[doc], side), np.minimum(offs[doc + 1] - pos, least)
                k = np.flatnonzero(keep & ~hot & (left + right >= least))
                if len(k):
                    p, d, l, r = pos[k], doc[k], left[k], right[k]
                    step, l, r = np.arange(-side, width - side, dtype=np.int16), l.astype(np.int16), r.astype(np.int16)
                    wide = np.concatenate([np.zeros(side, np.uint8), buf, np.zeros(width, np.uint8)])
                    context = np.lib.stride_tricks.sliding_window_view(wide, width)[p]
                    context[(step < -l[:, None]) | (step >= r[:, None])] = 0
                    same = _hash_rows(context) ^ textpack.mix(l.astype(np.uint64) * np.uint64(1000) + r.astype(np.uint64)) ^ h[k]
                    order = np.lexsort((p, clss[d], dids[d], same))
                    again = _again(same[order], h[k][order], l[order], r[order], context[order]) & (not all_of_them)
                    x, y = order[again], order[~again]
                    if len(x):
                        base = offs[d[x]]
                        yield local(dids[d[x]], clss[d[x]], p[x] - l[x] - base, p[x] + r[x] - base, same[x])
                    cols = [h[k[y]], dids[d[y]], clss[d[y]], p[y] - offs[d[y]], l[y], r[y], context[y]]
                    yield _dealt((textpack.mix(cols[0]) % np.uint64(buckets)).astype(np.int64), cols, _SENT, 0)
                k = np.flatnonzero(hot)
                if len(k):
                    over = np.zeros(len(buf) + 1, np.int32)
                    lo, hi = pos[k] - left[k], np.minimum(pos[k], offs[doc[k] + 1] - least) + 1
                    some = hi > lo
                    np.add.at(over, lo[some], 1)
                    np.add.at(over, hi[some], -1)
                    s = np.flatnonzero(np.cumsum(over)[:-1] > 0)
                    total = textpack.prefix_hash(buf)
                    w = textpack.mix((total[s + least] - total[s]) * textpack.powers(len(buf))[1][s])
                    total = textpack.prefix_hash(buf, _SECOND)
                    w2 = textpack.mix((total[s + least] - total[s]) * textpack.powers(len(buf))[1][s])
                    d = np.searchsorted(offs, s, "right") - 1
                    order = np.lexsort((s, clss[d], dids[d], w2, w))
                    again = np.concatenate(([False], (w[order][1:] == w[order][:-1]) & (w2[order][1:] == w2[order][:-1]))) & (not all_of_them)
                    x, y = order[again], order[~again]
                    if len(x):
                        x = np.sort(x)
                        run_at = np.flatnonzero(np.concatenate(([True], (s[x][1:] != s[x][:-1] + 1) | (d[x][1:] != d[x][:-1]))))
                        first, last = x[run_at], x[np.append(run_at[1:], len(x)) - 1]
                        base = offs[d[first]]
                        yield local(dids[d[first]], clss[d[first]], s[first] - base, s[last] + least - base, w[first])
                    none = np.zeros(len(y), np.int8)
                    cols = [w[y], dids[d[y]], clss[d[y]], s[y] - offs[d[y]], w2[y], none, none]
                    yield _dealt((textpack.mix(cols[0]) % np.uint64(buckets)).astype(np.int64), cols, _SENT, 1)

    kinds = "kind int, bucket int, h binary, did binary, cls binary, pos binary, left binary, right binary, context binary"
    return staged.select("did", "cls", "text", "h", "hot").mapInArrow(run, kinds)


def _again(same: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Whether a row equals the one before: by hash first, then by all its values."""
    out = np.concatenate(([False], same[1:] == same[:-1]))
    k = np.flatnonzero(out)
    for v in values:
        equal = v[k] == v[k - 1]
        out[k] &= equal.all(1) if v.ndim > 1 else equal
    return out


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each interval of a sorted list of strings that shares `depth` >= least leading bytes, from lcp[i] between strings i and i + 1, by one scan with a stack."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def maximal_repeats(left: list[bytes], right: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(l, r, members) of each maximal repeat over one anchor: members share the l bytes before it and the r from it on, l + r >= least.

    left holds what stands before each occurrence, reversed. Members of a
    prefix interval are sorted by it and scanned in turn: an interval there
    has differing left extensions, or none. A set that shares more to the
    right than its prefix interval is left to the deeper interval.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = [_common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    for r, i, j in prefix_intervals(lcp, 1):
        members = sorted(order[i : j + 1], key=left.__getitem__)
        back = [_common(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)]
        found = list(prefix_intervals(back, max(1, least - r)))
        if r >= least and (not found or min(back) == 0):
            found.append((0, 0, len(members) - 1))
        for l, a, b in found:
            own = members[a : b + 1]
            extensions = {left[x][l : l + 1] for x in own}
            if (len(extensions) > 1 or b"" in extensions) and (len(own) == j - i + 1 or len({right[x][r : r + 1] for x in own}) > 1 or any(len(right[x]) == r for x in own)):
                yield l, r, own


def _occurrences(table: pa.Table, gram: int, least: int, parts: int) -> pa.Table:
    """(part, cls, start, end): every occurrence of a repeat but its first, packed by document."""
    kind = table.column("kind")[0].as_py()
    h, did, cls, pos = (_gathered(table, c, t) for c, t in (("h", "<u8"), ("did", "<i8"), ("cls", "<i8"), ("pos", "<i8")))
    side = least - gram
    if kind == 2:
        out = [(did, cls, pos, _gathered(table, "left", "<i8"))]
    elif kind == 1:
        second = _gathered(table, "left", "<u8")
        order = np.lexsort((pos, cls, did, second, h))
        h, second, did, cls, pos = h[order], second[order], did[order], cls[order], pos[order]
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (second[1:] == second[:-1])))
        out = [(did[again], cls[again], pos[again], pos[again] + least)]
    else:
        left, right = (_gathered(table, c, "<i2").astype(np.int64) for c in ("left", "right"))
        context = _gathered(table, "context", "u1").reshape(len(h), -1)
        same = _hash_rows(context) ^ textpack.mix((left * 1000 + right).astype(np.uint64)) ^ h
        order = np.lexsort((pos, cls, did, same, h))
        h, did, cls, pos, left, right, context, same = (x[order] for x in (h, did, cls, pos, left, right, context, same))
        again = _again(same, h, left, right, context)
        out = [(did[again], cls[again], (pos - left)[again], (pos + right)[again])]
        one = ~again
        order = np.flatnonzero(one)
        order = order[np.lexsort((pos[order], cls[order], did[order], h[order]))]  # each anchor's first occurrence first
        h, did, cls, pos, left, right, context = (x[order] for x in (h, did, cls, pos, left, right, context))
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(start, len(h)))
        # most anchors have two contexts, a tree of two leaves: all pairs are compared at once
        a = start[size == 2]
        if len(a):
            b = a + 1
            differ = context[a] != context[b]
            r = np.where(differ[:, side:].any(1), differ[:, side:].argmax(1), least)
            l = np.where(differ[:, :side].any(1), differ[:, side - 1 :: -1].argmax(1) if side else 0, side)
            r, l = np.minimum(r, np.minimum(right[a], right[b])), np.minimum(l, np.minimum(left[a], left[b]))
            fine = l + r >= least
            a, b, l, r = a[fine], b[fine], l[fine], r[fine]
            out.append((did[b], cls[b], pos[b] - l, pos[b] + r))
        who, before_, after_ = array("q"), array("q"), array("q")
        for i, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            packed = [context[x].tobytes() for x in range(i, i + n)]
            before = [c[side - left[i + x] : side][::-1] for x, c in enumerate(packed)]
            after = [c[side : side + right[i + x]] for x, c in enumerate(packed)]
            for l, r, own in maximal_repeats(before, after, least):
                head = min(own)
                for x in own:
                    if x != head:
                        who.append(i + x)
                        before_.append(l)
                        after_.append(r)
        who, l, r = (np.array(x, np.int64) for x in (who, before_, after_))
        order = np.lexsort((-r, -l, who))
        who, l, r = who[order], l[order], r[order]
        if len(who):  # of one occurrence, what no wider repeat covers
            seen = np.maximum.accumulate(r + who * 1024)
            keep = np.concatenate(([True], (who[1:] != who[:-1]) | (r[1:] + who[1:] * 1024 > seen[:-1])))
            who, l, r = who[keep], l[keep], r[keep]
        out.append((did[who], cls[who], pos[who] - l, pos[who] + r))
    did, cls, start, end = (np.concatenate(c) for c in zip(*out, strict=True))
    names = ["part", "cls", "start", "end"]
    return pa.Table.from_batches([_dealt((textpack.mix(cls.view(np.uint64)) % np.uint64(parts)).astype(np.int64), [cls, start, end], names)])


_GROUPS = pa.schema([("grp", pa.int64()), ("length", pa.int64()), ("did", pa.int64()), ("cls", pa.int64()), ("start", pa.int64())])


def _groups(table: pa.Table, gram: int, least: int) -> pa.Table:
    """(grp, length, did, cls, start) of all occurrences of each maximal repeat in these contexts."""
    h, did, cls, pos = (_gathered(table, c, t) for c, t in (("h", "<u8"), ("did", "<i8"), ("cls", "<i8"), ("pos", "<i8")))
    side, grp, length, who, start = least - gram, [], [], [], []
    if table.column("kind")[0].as_py() == 1:
        second = _gathered(table, "left", "<u8")
        order = np.lexsort((second, h))
        cut = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1]))))
        for i, j in zip(cut, np.append(cut[1:], len(h)), strict=True):
            if j - i > 1:
                own = order[i:j]
                grp += [int(h[own[0]].view(np.int64))] * len(own)
                length += [least] * len(own)
                who += own.tolist()
                start += pos[own].tolist()
    else:
        left, right = (_gathered(table, c, "<i2").astype(np.int64) for c in ("left", "right"))
        context = _gathered(table, "context", "u1").reshape(len(h), -1)
        order = np.lexsort((pos, cls, did, h))
        cut = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        for i, j in zip(cut, np.append(cut[1:], len(h)), strict=True):
            own = order[i:j]
            packed = [context[x].tobytes() for x in own]
            before = [c[side - left[x] : side][::-1] for x, c in zip(own, packed, strict=True)]
            after = [c[side : side + right[x]] for x, c in zip(own, packed, strict=True)]
            for l, r, members in maximal_repeats(before, after, least):
                x = own[members]
                text = np.frombuffer(before[members[0]][:l][::-1] + after[members[0]][:r], np.uint8)
                grp += [int(textpack.mix(textpack.prefix_hash(text)[-1:])[0].view(np.int64))] * len(x)
                length += [l + r] * len(x)
                who += x.tolist()
                start += (pos[x] - l).tolist()
    who = np.array(who, np.int64)
    return pa.table([pa.array(grp, pa.int64()), pa.array(length, pa.int64()), pa.array(did[who]), pa.array(cls[who]), pa.array(start, pa.int64())], schema=_GROUPS)


def _spans(table: pa.Table) -> pa.Table:
    """(cls, starts, ends): the union of what later occurrences cover, by document."""
    cls, start, end = (_gathered(table, c, "<i8") for c in ("cls", "start", "end"))
    if not len(cls):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["cls", "starts", "ends"])
    order = np.lexsort((start, cls))
    cls, start, end = cls[order], start[order], end[order]
    doc = np.cumsum(np.concatenate(([0], cls[1:] != cls[:-1])))
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + doc * wide)
    cut = np.flatnonzero(np.concatenate(([True], start[1:] + doc[1:] * wide > reach[:-1])))
    ends = (reach - doc * wide)[np.append(cut[1:], len(cls)) - 1]
    cls, start = cls[cut], start[cut]
    by = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    till = np.append(by[1:], len(cls))
    pick = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(by, till, strict=True)], pa.binary())
    return pa.table([pa.array(cls[by]), pick(start), pick(ends)], names=["cls", "starts", "ends"])


def _at_characters(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans shrunk to the character boundaries inside them."""
    bounds = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))
    starts = bounds[np.searchsorted(bounds, starts, "left")]
    ends = bounds[np.searchsorted(bounds, ends, "right") - 1]
    return starts[starts < ends], ends[starts < ends]


def _classed(docs: DataFrame, most_tries: int = 20) -> tuple[DataFrame, DataFrame, DataFrame, Column, Callable[[Column], Column]]:
    """(did, cls, text), base and firsts, the column that gives cls, and the way from did back to doc_id. If two texts share a hash, all are hashed again with another seed."""
    did, back = common.ordered_ids(docs)
    for seed in range(most_tries):
        cls = F.xxhash64(F.lit(seed), F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
        rows = docs.select(did.alias("did"), cls.alias("cls"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
        base = common.written(rows.select("did", "cls", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "base")
        firsts = common.written(base.groupBy("cls").agg(F.min("did").alias("did"), F.min("sha").alias("sha"), F.max("sha").alias("other")), "firsts")
        if firsts.where("sha <> other").isEmpty():
            return rows, base, firsts.select("cls", "did"), cls, back
        common.drop_written(base)
    raise RuntimeError("no seed tells all texts apart")


def find_repeats(docs: DataFrame, least: int = 100, gram: int = GRAM, hot: int = HOT, groups: bool = False) -> dict:
    """What is found in documents with columns doc_id and text, by name.

    base: did (a long for doc_id, in its order), cls, n_bytes, sha and first (whether the row is its class's
    first) of every row. staged: the first of each class that holds a repeated anchor, with its text.
    found: where later occurrences of repeats are, packed; with `groups`, the rows of repeat_groups().
    cls, back: the column that gives a row's class, and the way from did to doc_id.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows, base, firsts, cls, back = _classed(docs)
    buckets = max(common.partitions(spark, 4), base.count() // 2000)
    parts = max(8, buckets // 16)  # a row goes from each bucket to each part
    found = _anchor_postings(rows, gram, least, buckets, parts, hot).groupBy("kind", "bucket").applyInArrow(lambda t: _repeated(t, parts, hot), "part int, h binary, cls binary, hot binary")
    found = found.groupBy("part").applyInArrow(_by_class, "cls long, h binary, hot binary")
    wanted = common.written(found.join(firsts, "cls"), "repeated")
    staged = common.written(rows.join(wanted, ["did", "cls"]).select("did", "cls", "text", "h", "hot"), "staged")
    common.drop_written(wanted)
    sent = _contexts(staged, gram, least, buckets, groups).groupBy("kind", "bucket")
    if groups:
        seen = sent.applyInArrow(lambda t: _groups(t, gram, least), "grp long, length long, did long, cls long, start long")
    else:
        seen = sent.applyInArrow(lambda t: _occurrences(t, gram, least, parts), "part int, cls binary, start binary, end binary")
    base = base.join(firsts.withColumn("first", F.lit(True)), ["did", "cls"], "left").fillna(False, ["first"])
    return {"base": base, "staged": staged, "found": seen, "cls": cls, "back": back}


def repeat_groups(docs: DataFrame, least: int = 100, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(grp, length, doc_id, start): occurrences, the first included, of repeats of `least` bytes or more; start counts bytes, grp is a hash of the string.

    A repeat is maximal in what is looked at around an anchor: `least` - gram
    bytes before it and `least` from it on. So a longer passage comes as the
    overlapping groups of its anchors, and over an anchor that is split as one
    group for each window. Any two occurrences of a string of `least` bytes
    are together in some group that covers it, and a group of just `least`
    bytes lists all; of a longer one, those around which the same anchor is
    chosen. Of equal texts only the first, by doc_id, is listed.
    Nulls, ties and repeated rows are taken as by remove_repeats().
    """
    found = find_repeats(docs, least, gram, hot, groups=True)
    return found["found"].select("grp", "length", found["back"](F.col("did")).alias("doc_id"), "start").distinct()


def remove_repeats(docs: DataFrame, least: int = 100, gram: int = GRAM, hot: int = HOT, whole_characters: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """All rows as (did, cls, n_bytes, sha, first), the rows that lose bytes as (did, cls, n_removed, n_spans, kept, starts, ends), and what find_repeats() gave.

    did is a long in the order of doc_id. Of texts that occur more than
    once only the first row is in the second table; the others, where `first`
    is false, lose all their bytes if they have `least` or more.

    Every byte goes that a string of `least` bytes covers which also starts
    earlier: in a smaller doc_id, or earlier in the same document; judged on
    the input, not on what is left. Strings never cross documents.

    With whole_characters a character stays unless all its bytes go, so that
    what is kept is UTF-8 if the text was.

    Null texts count as empty. A null doc_id comes after all others. Rows
    equal in doc_id and text are one document and get one result; rows of one
    doc_id with other texts are ordered by a hash of the text. Other columns
    are not read. An empty table gives no rows.
    """
    found = find_repeats(docs, least, gram, hot)
    base, staged = found["base"], found["staged"]
    spans = common.written(found["found"].groupBy("part").applyInArrow(_spans, "cls long, starts binary, ends binary"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in textpack.slices(batch, "text"):
                removed, runs, kept = [], [], []
                for d, (starts, ends) in enumerate(zip(part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True)):
                    text = buf[offs[d] : offs[d + 1]].tobytes()
                    starts, ends = np.frombuffer(starts, "<i8"), np.frombuffer(ends, "<i8")
                    if whole_characters:
                        starts, ends = _at_characters(buf[offs[d] : offs[d + 1]], starts, ends)
                    removed.append(int((ends - starts).sum()))
                    runs.append(len(starts))
                    kept.append(b"".join(text[i:j] for i, j in zip(np.append(0, ends), np.append(starts, len(text)), strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("did"), part.column("cls"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), part.column("starts"), part.column("ends")], names=["did", "cls", "n_removed", "n_spans", "kept", "starts", "ends"])

    cleaned = staged.select("did", "cls", "text").join(spans, "cls").mapInArrow(run, "did long, cls long, n_removed long, n_spans long, kept binary, starts binary, ends binary")
    return base, cleaned, found


def cleaned_documents(docs: DataFrame, least: int = 100) -> DataFrame:
    """docs with text and n_chars as they are without repeats, in whole characters; rows that lose all their text go.

    Other columns stay, whatever their names. Null and empty texts stay. Nulls
    in doc_id, ties, repeated rows and an empty table are taken as by
    remove_repeats(). Text becomes characters again after whole characters
    went, so a text that was no UTF-8 is not expected.
    """
    base, cleaned, found = remove_repeats(docs, least, whole_characters=True)
    gone = base.where(~F.col("first") & (F.col("n_bytes") >= least)).select("did", "cls", F.lit(b"").alias("kept"))
    changes = cleaned.select("did", "cls", "kept").union(gone)
    if base.count() > base.select("did", "cls").distinct().count():  # repeated rows are one document
        changes = changes.dropDuplicates(["did", "cls"])
    did, cls, kept = common.free_names(docs.columns, "did", "cls", "kept")
    changes = changes.withColumnsRenamed({"did": did, "cls": cls, "kept": kept})
    rows = docs.withColumns({did: common.ordered_ids(docs)[0], cls: found["cls"]})
    rows = rows.join(changes, [did, cls], "left").where(F.col(kept).isNull() | (F.octet_length(kept) > 0))
    rows = rows.withColumn("text", F.coalesce(F.col(kept).cast("string"), F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents lose and keep; as remove_repeats() says."""
    base, cleaned, found = remove_repeats(common.documents(spark, sf_dir))
    cleaned = cleaned.select("did", "cls", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).distinct()
    copy = ~F.col("first") & (F.col("n_bytes") >= 100)
    out = base.join(cleaned, ["did", "cls"], "left")
    return out.select(
        found["back"](F.col("did")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )

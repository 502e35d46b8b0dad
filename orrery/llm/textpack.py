"""Vectorised hashing of packed texts, used inside Arrow tasks.

A *pack* is one uint8 buffer with the UTF-8 bytes of several documents and an
int64 offset array, taken straight from an Arrow binary column. Every function
works on whole packs with numpy, so no Python loop runs per byte or per word.

Hashes are 64 bits wide: a random table per byte, a polynomial over the
positions (mod 2**64, odd base, hence invertible) and a final mixer. They
depend on the bytes alone, so every executor computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
#: Bytes that separate words: space, and tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTES = _random(256, 11)
FOLDED = BYTES.copy()
FOLDED[0x41:0x5B] = FOLDED[0x61:0x7B]
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_STEPS = _random(64, 12)
_power: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse, to the power 0 to n."""
    global _power
    if len(_power[0]) <= n:
        m = max(n + 1, 1 << 20)
        out = []
        for x in (_BASE, _INVERSE):
            p = np.full(m, x, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _power = (out[0], out[1])
    return _power


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that high and low bits are both usable."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a binary or string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1 + at)[at:] if n else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, offs[-1])[offs[0] :], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose text has at most `most` bytes (a longer text has its own), with their packs."""
    buf, offs = packed(batch.column(column))
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1))
        yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def prefix_hash(buf: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """Running polynomial sums with a leading 0."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def words(buf: np.ndarray, offs: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z in lower case if fold), and the words before each document's first one."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = _IS_WORD[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    total = prefix_hash(buf, FOLDED if fold else BYTES)
    h = mix((total[end] - total[start]) * powers(len(buf))[1][start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, offs)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; the last n - 1 are missing."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _STEPS[k]
    return mix(out)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles of one document, ascending; a shorter text is one shingle, no words none."""
    if 0 < len(h) < n:
        return ngrams(h, len(h))
    out = ngrams(h, n)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out

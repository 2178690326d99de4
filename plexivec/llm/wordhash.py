"""Hashes of words, shingles and character n-grams for whole Arrow batches of texts, in numpy.

Works on the UTF-8 bytes of a batch at once: a word's hash is a difference of running sums of byte
values times powers of an odd number, all modulo 2**64, so no Python runs for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; also the bytes of text, about, whose hashes are held at once.
BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK)
        inverse = pow(_ODD, -1, 2**64)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))]) for base in (_ODD, inverse)]
    return _powers[0], _powers[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow array, and the offsets of each; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes together, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _pieces(raw: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end after a blank, or at ``hi``."""
    while lo < hi:
        end = min(lo + BLOCK, hi)
        while end < hi and not _BLANK[raw[end - 1]]:
            found = np.flatnonzero(_BLANK[raw[end : end + BLOCK]])
            end = min(end + (int(found[0]) + 1 if len(found) else BLOCK), hi)
        yield lo, end
        lo = end


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (byte positions) of all words of the documents, and the first word of each document (with an end).

    Words are runs of bytes other than space and \\x09 to \\x0D, A-Z in lower case, and end with their document.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    hashes, starts, ends = [], [], []
    for a, b in _pieces(raw, lo, hi):
        part = raw[a:b]
        inside = ~_BLANK[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        first[cut] = inside[cut]
        cut = cut[cut > 0] - 1
        last[cut] = inside[cut]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + a)
        ends.append(e + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, offsets)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; with fewer words, one of the whole sequence."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < n:
        out = np.uint64(len(hashes))
        for h in hashes:
            out = mix(np.array([out * np.uint64(_ODD) + h], np.uint64))[0]
        return np.array([out], np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(_ODD) + hashes[k : len(hashes) - n + 1 + k])
    return out

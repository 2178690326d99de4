"""Character n-grams of whole texts as 64-bit codes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points handled at once, so that a very long text needs bounded memory.
SPAN = 1 << 20
_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letter:
        _letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letter[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def padded_words(text: str) -> np.ndarray:
    """Code points of the text in lower case: letters, with one space for all between, before and after."""
    c = code_points(text.lower())
    c = np.where(letters()[c], c, np.uint32(32))
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    space = c == 32
    return c[~(space & np.concatenate([[False], space[:-1]]))]


def ngrams(c: np.ndarray) -> np.ndarray:
    """Codes of the runs of 1, 2 and 3 of ``padded_words``; a space only at the ends of a run of 2 or 3."""
    space = c == 32
    two = c[:-1] << np.uint64(21) | c[1:]
    three = c[:-2] << np.uint64(42) | two[1:]
    return np.concatenate([c[~space], two, three[~space[1:-1]]])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram codes of a whole text and their counts, a span at a time."""
    c = padded_words(text)
    if len(c) <= SPAN:
        return np.unique(ngrams(c), return_counts=True) if len(c) > 2 else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    parts = [_span(c, at) for at in range(0, len(c), SPAN)]
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _span(c: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-grams that start in one span."""
    part, n = c[at : at + SPAN + 2], min(SPAN, len(c) - at)
    space = part == 32
    two = part[:-1] << np.uint64(21) | part[1:]
    three = part[:-2] << np.uint64(42) | two[1:]
    return np.unique(np.concatenate([part[:n][~space[:n]], two[:n], three[:n][~space[1:-1][:n]]]), return_counts=True)


def trigram_codes(c: np.ndarray, bits: int) -> np.ndarray:
    """Hashed buckets of the trigrams of a run of code points."""
    p = c.astype(np.uint64)
    code = (p[:-2] << np.uint64(42)) | (p[1:-1] << np.uint64(21)) | p[2:]
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def trigram_buckets(text: str, bits: int) -> Iterator[np.ndarray]:
    """Hashed buckets of all character trigrams of a whole text (one space before and after), a span at a time."""
    c = code_points(f" {text} ")
    for at in range(0, max(len(c) - 2, 0), SPAN):
        yield trigram_codes(c[at : at + SPAN + 2], bits)

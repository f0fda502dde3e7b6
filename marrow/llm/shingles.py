"""Hashed word shingles of many texts at once, in numpy.

Words are runs of ASCII letters, digits and bytes of other scripts, with A-Z lower-cased; a shingle is SHINGLE
consecutive words.  A text with fewer words, but not none, is one shingle of all its words."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the text each is in."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    inside = _IN_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = ends - starts
    at = np.flatnonzero(inside)
    within = at - np.repeat(starts, size)
    powers = np.cumprod(np.full(int(size.max()), np.uint64(0x100000001B3)), dtype=np.uint64)
    hashes = mix(np.add.reduceat(_BYTE[data[at]] * powers[within], np.r_[0, np.cumsum(size)[:-1]]) + size.astype(np.uint64))
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.searchsorted(bounds, starts, "right")


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count): the multiset of each text's shingles, sorted by text and shingle."""
    words, where = _words(texts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = np.bincount(where, minlength=len(texts))
    padded = np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)])
    owner = np.concatenate([where, np.full(SHINGLE - 1, -1)])
    first = np.r_[0, np.cumsum(n)[:-1]]
    short = (n > 0) & (n < SHINGLE)
    total = np.zeros(len(words), np.uint64)
    for j in range(SHINGLE):
        same = owner[j : j + len(words)] == where
        total = (total + np.where(same, padded[j : j + len(words)], np.uint64(0))) * np.uint64(0xD6E8FEB86659FD93 + 2 * j)
    whole = owner[SHINGLE - 1 :] == where
    whole[first[short]] = True
    doc, h = where[whole], mix(total[whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.r_[at, len(doc)])


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum()
    return float(both / (a[1].sum() + b[1].sum() - both))

"""Words and shingles of many texts at once, as 64-bit hashes, by NumPy over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: letters and digits of ASCII, and every byte of other characters.
WORD = np.array([48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
#: Bytes between words when only ASCII white space parts them.
NOT_SPACE = np.array([not (i == 32 or 9 <= i <= 13) for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _STEP)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, dtype=_U), np.full(size, pow(_BASE, -1, 1 << 64), dtype=_U)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every longest run of member bytes within one text."""
    inside = member[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each of the ascending spans that do not overlap."""
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _powers(len(data) + 1)
    value = _BYTE[data]
    value *= up[: len(data)]
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, stops
    if edges[-1] == len(data):
        sums = np.add.reduceat(value, edges[:-1])[0::2]
    else:
        sums = np.add.reduceat(value, edges)[0::2]
    return mix(sums * down[starts] + (stops - starts).astype(_U) * _STEP)


def word_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word in order; A-Z count as a-z."""
    lower = _LOWER[data]
    starts, stops, text = runs(lower, offsets, member)
    return span_hashes(lower, starts, stops), text


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of k-word shingles, text after text, and their offsets. With fewer words the whole sequence is one shingle."""
    n = len(offsets) - 1
    hashes, text = word_hashes(data, offsets, NOT_SPACE)
    words = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    m = len(hashes)
    if not m:
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    span = np.minimum(words, k)
    pos = np.arange(m) - first[text]
    keep = pos + span[text] <= words[text]
    total = np.zeros(m, _U)
    size = span[text]
    factor = 1
    for j in range(min(k, m)):
        total[: m - j] += np.where(size[: m - j] > j, hashes[j:], _U(0)) * _U(factor)
        factor = factor * _BASE % (1 << 64)
    total = mix(total + size.astype(_U) * _STEP)
    total, owner = total[keep], text[keep]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[new], owner[new]
    return total, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])

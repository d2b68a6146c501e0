"""Hashed word shingles of whole texts, by array arithmetic over a batch's bytes."""

from __future__ import annotations

import numpy as np

from .fingerprints import _table, mixed

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text data[offsets[i]:offsets[i+1]] the sorted distinct 64-bit hashes of its shingles.

    Words are runs without blanks (U+0020, U+0009 to U+000D), A-Z lower-cased.
    A text of fewer words is one shingle; one without words has none.
    """
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    blank = _BLANK[data]
    opens = ~blank
    opens[1:] &= blank[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] = ~blank[inner]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    stops = np.flatnonzero(blank)
    stops = np.union1d(np.append(stops, len(data)), inner)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    power, inverse = _table(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * power, out=sums[1:])
    word = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)  # words before each text
    seeds = mixed(np.arange(1000, 1000 + words, dtype=np.uint64)) | np.uint64(1)
    full = len(word) - words + 1
    rolled = np.zeros(max(full, 0), np.uint64)
    for k in range(words):
        rolled += word[k : k + max(full, 0)] * seeds[k]
    rolled = mixed(rolled)
    out = []
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mixed(np.array([(word[a:b] * seeds[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on whole sets."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 100 * small < percent * large:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)

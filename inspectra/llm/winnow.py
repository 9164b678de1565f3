"""Content-defined anchors of all windows of a sequence, by winnowing, in numpy.

A window of `width` items holds w = width - k + 1 grams of k items. Its anchor is its leftmost
smallest gram hash, so equal windows have equal anchors at equal offsets, wherever
they stand. Neighbouring windows mostly share their anchor; such a run is one row.
"""

from __future__ import annotations

import numpy as np

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(32)


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive items (uint64, well mixed): differences of one running sum of items * base**-i."""
    n = len(items)
    if n < k:
        return np.zeros(0, np.uint64)
    if len(_powers[0]) < n:
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n * 5 // 4, base, np.uint64)
            p[0] = 1
            _powers[at] = np.multiply.accumulate(p)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(items * _powers[1][:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers[0][: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive numbers, at a cost that does not grow with w."""
    n = len(x)
    pad = np.full(-(-n // w) * w, _FULL)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def runs(items: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, hash, segment) of each run of windows with one anchor; positions in `items`, which holds segments one after another."""
    none = np.zeros(0, np.int64)
    windows = lengths - width + 1
    some = np.flatnonzero(windows > 0)
    if not len(some):
        return none, none, none, none.view(np.uint64), none
    windows = windows[some]
    segment = np.repeat(some, windows)
    start = np.arange(len(segment)) + np.repeat(offsets[some] - (np.cumsum(windows) - windows), windows)
    h = gram_hashes(items, k)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    place = (np.uint64(1) << bits) - np.uint64(1)
    low = sliding_min(h & ~place | np.arange(len(h), dtype=np.uint64), width - k + 1)
    anchor = (low[start] & place).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])])
    return start[first], np.diff(np.r_[first, len(start)]), anchor[first], h[anchor[first]], segment[first]

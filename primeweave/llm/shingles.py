"""Hashes of words and of word shingles, vectorised over the bytes of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_DRAW = np.random.default_rng(20240229)
_BYTE = _DRAW.integers(1, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_STEP = int(_DRAW.integers(1 << 62, 1 << 63)) * 2 + 1
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The step's powers and their inverses modulo 2**64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, BLOCK + 1)
        _POWERS[:] = []
        for step in (_STEP, pow(_STEP, -1, 1 << 64)):
            out = np.ones(n, np.uint64)
            out[1:] = step & (1 << 64) - 1
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (bytes between blanks, A-Z lowered) and where it starts; no word crosses a cut."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = cuts[cuts < len(data)]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~(inside[1:] & ~first[1:])
    ends = np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, in blocks that end at blanks where the words allow it."""
    out, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not _BLANK[data[end]]:
            near = np.flatnonzero(_BLANK[data[end : end + BLOCK]])
            end = end + int(near[0]) if len(near) else min(end + BLOCK, len(data))
        out.append(word_hashes(data[at:end], np.zeros(0, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _chain(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + n])
    return out


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of fewer words, the one of them all; of none, nothing."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = at + 1
        while end < len(column) and offsets[end + 1] - offsets[at] <= BLOCK:
            end += 1
        if end == at + 1:
            words, cut = _long(data[offsets[at] : offsets[end]]), None
            cut = np.array([0, len(words)])
        else:
            words, starts = word_hashes(data[offsets[at] : offsets[end]], offsets[at:end] - offsets[at])
            cut = np.searchsorted(starts, offsets[at : end + 1] - offsets[at])
        whole = _chain(words, size)
        for k in range(end - at):
            a, b = cut[k], cut[k + 1]
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            else:
                yield _chain(words[a:b], int(b - a)) if b > a else whole[:0]
        at = end

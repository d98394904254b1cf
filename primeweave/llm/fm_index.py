"""An FM-index over a sequence of word numbers: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling over the suffixes whose rank isn't settled yet."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    heads = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[order] = heads[np.cumsum(new) - 1]
    rank[n] = -1
    span = 1
    while True:
        size = np.diff(np.append(heads, n))
        open_rows = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_rows):
            return order
        at = order[open_rows]
        group, key = rank[at], rank[np.minimum(at + span, n)]
        by = np.lexsort((key, group))
        at, group, key = at[by], group[by], key[by]
        order[open_rows] = at
        new[open_rows] = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        heads = np.flatnonzero(new)
        rank[order[open_rows]] = heads[np.cumsum(new)[open_rows] - 1]
        span *= 2


class WaveletMatrix:
    """Ranks of symbols below 2**bits: one bit vector a level, zeros first in the next."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        lo, hi = np.zeros_like(upto), upto
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol, lo, hi = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[hi + 1] > ones[hi]
            symbol = symbol * 2 + one
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return symbol, hi - lo


class FMIndex:
    """Over runs of symbols 1..m, each run closed by a 0; a pattern has no 0 and so stays within a run."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        text = text.astype(np.int64)
        n, top = len(text), int(text.max(initial=0))
        closes = text == 0
        runs = int(closes.sum())
        keys = text + runs - 1
        keys[closes] = np.arange(runs)  # each 0 differs, so suffixes end there
        self.sa = suffix_array(keys)
        before = np.where(self.sa > 0, text[self.sa - 1], 0) if n else text
        self.bits = max(1, top.bit_length())
        self.tree = WaveletMatrix(before, self.bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        starts = np.concatenate([[True], closes[:-1]]) if n else closes
        self.sampled = (self.sa % sample == 0) | starts[self.sa]  # a walk stops at its run's start at the latest
        self.at = np.where(self.sampled, self.sa, -1)
        del self.sa
        self.n, self.top = n, top

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns of one length, one a row, by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        known = (patterns <= self.top).all(axis=1)
        hi[~known] = 0
        patterns = np.where(known[:, None], patterns, 0)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            c = patterns[live, k]
            lo[live], hi[live] = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back until a sampled one."""
        out, steps, at = np.full(len(rows), -1, np.int64), 0, rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.at[at[done]] + steps
            todo, at = todo[~done], at[~done]
            c, r = self.tree.access_rank(at)
            at = self.first[c] + r
            steps += 1
        return out

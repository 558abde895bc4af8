"""FM-index over a sequence of word numbers, kept in numpy arrays: one bounded shard of texts at a time.

Number 0 separates runs of words and never matches. Suffixes are in full order; separators are ordered by
their place, so that each suffix differs from all others at the first separator at the latest.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by prefix doubling that goes on with tied suffixes only."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(seq.max()).bit_length())
    depth = max(1, 62 // bits)
    seps = np.flatnonzero(seq == 0)
    room = np.append(seps, n)[np.searchsorted(seps, np.arange(n))] - np.arange(n)  # words up to the next separator
    key = np.zeros(n, np.int64)
    for step in range(min(depth, n)):  # words beyond a separator count as none
        key <<= bits
        key[:n - step] |= np.where(room[:n - step] > step, seq[step:], 0)
    rank = np.empty(n, np.int64)
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])
    group = np.flatnonzero(fresh)
    rank[order] = group[np.cumsum(fresh) - 1]
    size = np.zeros(n, np.int64)
    size[group] = np.diff(np.append(group, n))
    active = np.flatnonzero((size[rank] > 1) & (room >= depth))
    while len(active):
        ahead = np.where(active + depth < n, rank[np.minimum(active + depth, n - 1)] + 1, 0)
        order = np.argsort(rank[active] * (n + 1) + ahead)
        active, ahead = active[order], ahead[order]
        old = rank[active]
        outer = np.append(True, old[1:] != old[:-1])
        fresh = outer | np.append(True, ahead[1:] != ahead[:-1])
        at = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(outer, at, 0))
        inner = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = old + inner - begin
        ends = np.append(np.flatnonzero(fresh)[1:], len(active))
        size[rank[active[fresh]]] = ends - np.flatnonzero(fresh)
        depth *= 2
        active = np.sort(active)
        active = active[(size[rank[active]] > 1) & (room[active] >= depth)]
    tied = np.flatnonzero(size[rank] > 1)
    if len(tied):  # equal up to a separator: in order of place
        tied = tied[np.argsort(rank[tied], kind="stable")]
        old = rank[tied]
        at = np.arange(len(tied))
        rank[tied] = old + at - np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Wavelet:
    """Wavelet tree in matrix form: one bit vector a level with running counts."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (values >> shift & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(values) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        begin, end = np.zeros(len(place), np.int64), place.astype(np.int64)
        for shift, ones, zeros in self.levels:
            bit = (symbol >> shift & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin, end = np.where(bit, zeros + b, begin - b), np.where(bit, zeros + e, end - e)
        return end - begin


class FmIndex:
    def __init__(self, seq: np.ndarray):
        """``seq`` ends with a separator."""
        order = suffix_array(seq).astype(np.int32 if len(seq) < 2**31 else np.int64)
        self.last = seq[order - 1]  # order 0: the closing separator
        bits = max(1, int(seq.max()).bit_length())
        self.least = np.zeros(2**bits + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=2**bits), out=self.least[1:])
        self.size = len(seq)
        self.tree = Wavelet(self.last, bits)
        kept = (order % SAMPLE == 0) | (self.last == 0)
        self.kept = np.zeros(len(seq) + 1, np.int32)
        np.cumsum(kept, out=self.kept[1:])
        self.places = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns of one length (rows; every symbol over 0): the interval of suffixes that begin with each."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            symbol = np.minimum(column[live], len(self.least) - 1)  # a word that the shard lacks has an empty interval
            known = column[live] < len(self.least) - 1
            start = self.least[symbol]
            low[live] = np.where(known, start + self.tree.rank(symbol, low[live]), 0)
            high[live] = np.where(known, start + self.tree.rank(symbol, high[live]), 0)
            live = live[low[live] < high[live]]
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes at these rows: step back word by word to a sampled place."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            hit = self.kept[at + 1] > self.kept[at]
            out[left[hit]] = self.places[self.kept[at[hit]]] + steps
            left, at = left[~hit], at[~hit]
            symbol = self.last[at]
            rows[left] = self.least[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out

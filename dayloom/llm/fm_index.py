"""An FM-index over a sequence of symbols: wavelet-matrix ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of all suffixes in order; a shorter suffix precedes its extensions.

    Prefix doubling: the first sort compares as many symbols as fit into 63 bits, later rounds
    sort only the suffixes that still tie, by the rank of the suffix twice as far on.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    reach = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key <<= bits
        key[: n - k] |= text[k:] + 1 if k < n else 0
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)  # of a suffix: the place of the first one that ties with it
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        at = order[places]
        ahead = np.zeros(len(at), np.int64)
        inside = at + reach < n
        ahead[inside] = rank[at[inside] + reach] + 1
        pair = rank[at] * (n + 1) + ahead
        by = np.argsort(pair)
        pair, at = pair[by], at[by]
        order[places] = at
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        head[places] = new
        rank[at] = np.maximum.accumulate(np.where(new, places, 0))
        reach *= 2


class FMIndex:
    """``text`` holds symbols from 0 to ``top``; patterns are searched all at once."""

    def __init__(self, text: np.ndarray, top: int):
        self.n = len(text)
        self.bits = max(1, int(top + 1).bit_length())
        order = suffix_array(text.astype(np.int64), self.bits)
        self.last = np.roll(text, 1)[order].astype(np.int32)  # the symbol before each suffix
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.sampled = order % SAMPLE == 0
        self.positions = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1
        # Cyclic rank order: the suffix at 0 is preceded by the text's last symbol, whose own
        # suffix is the shortest one starting with it and so the first of its symbol.
        self.levels, self.zeros = [], []
        row = self.last
        for level in reversed(range(self.bits)):
            bit = (row >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            mask = bit.astype(bool)
            row = np.concatenate([row[~mask], row[mask]])
        self.wrap = int(np.flatnonzero(order == 0)[0]) if self.n else 0
        self.tail = int(text[-1]) if self.n else -1

    def occ(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in ``last[:row]``."""
        low, high = np.zeros_like(row), row.copy()
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            set_ = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low = np.where(set_, zeros + a, low - a)
            high = np.where(set_, zeros + b, high - b)
        return high - low

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First row, at or after which come the suffixes ``symbol`` + (those from ``row`` on).

        The text's last symbol stands before the suffix at 0 only because rows are cyclic: its own
        suffix is the first of its symbol, so other rows of that symbol shift by it.
        """
        count = self.occ(symbol, row)
        own = symbol == self.tail
        count = count + (own & (row <= self.wrap))
        return self.before[symbol] + count

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of patterns, the rows of a matrix padded with -1 on the left."""
        final = patterns[:, -1]
        low, high = self.before[final], self.before[final + 1]
        live = np.flatnonzero(high > low)
        for k in reversed(range(patterns.shape[1] - 1)):
            rows = live[patterns[live, k] >= 0]
            symbol = patterns[rows, k]
            low[rows], high[rows] = self.step(symbol, low[rows]), self.step(symbol, high[rows])
            live = live[high[live] > low[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one, all rows in step."""
        out = np.zeros(len(rows), np.int64)
        left, at, walked = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            found = self.sampled[at]
            out[left[found]] = self.positions[self.sample_rank[at[found]]] + walked
            left, at = left[~found], at[~found]
            at = self.step(self.last[at].astype(np.int64), at)
            walked += 1
        return out

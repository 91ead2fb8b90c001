"""A run-length grammar by recompression, and longest common extensions over its levels.

Block compression replaces every maximal run of one symbol by a symbol for (symbol, length), pair
compression every two neighbours whose symbols lie in a left and a right class. What a symbol becomes
follows from its neighbours alone, so equal stretches are parsed alike but for their ends, and an
extension query climbs and descends the levels with at most two comparisons on each.
"""

from __future__ import annotations

import numpy as np

FEW = 4  # symbols of a text from which its levels end
IDLE = 16  # rounds without a shorter level after which they end as well
_MIX = np.uint64(0x9E3779B97F4A7C15)  # spreads symbols over the two classes


class Level:
    """The symbols of one level and how they group into those of the next."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, blocks: bool):
        self.symbols, self.blocks = symbols, blocks
        self.starts = starts.astype(np.int32)  # of the phrases, and the end of the last one
        lengths = np.diff(self.starts)
        self.phrase = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)

    def at_start(self, x: np.ndarray) -> np.ndarray:
        return self.starts[self.phrase[x]] == x

    def left(self, x: np.ndarray) -> np.ndarray:
        """How many symbols of its phrase are at or after ``x``."""
        return self.starts[self.phrase[x] + 1] - x


class Grammar:
    """Levels over texts that are separated, preceded and followed by symbols of their own.

    ``symbols`` holds numbers from 0; those up to ``separators`` occur once each and stay as they are.
    """

    def __init__(self, symbols: np.ndarray, separators: int):
        now = symbols.astype(np.int32)
        fresh = int(now.max(initial=0)) + 1
        self.levels: list[Level] = []
        idle = turn = 0
        while idle < IDLE and np.diff(np.flatnonzero(now < separators)).max(initial=0) > FEW:
            for step in (_blocks, _pairs):
                starts, names, fresh = step(now, separators, fresh, turn)
                if len(names) < len(now):
                    self.levels.append(Level(now, starts, step is _blocks))
                    idle, now = 0, names
                else:
                    idle += 1
                turn += 1
        self.top = now

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many symbols from ``x`` and from ``y`` on (different places) are equal, pair by pair."""
        origin = x
        x, y = x.astype(np.int32), y.astype(np.int32)
        ended = np.full(len(x), -1, np.int32)  # the level on which a pair was found to differ
        live = np.arange(len(x))
        for k, level in enumerate(self.levels):
            live = self._climb(level, k, x, y, ended, live)
        while len(live):
            same = self.top[x[live]] == self.top[y[live]]
            ended[live[~same]] = len(self.levels)
            live = live[same]
            x[live] += 1
            y[live] += 1
        for k in reversed(range(len(self.levels))):
            level, here = self.levels[k], np.flatnonzero(ended > k)
            a, b = level.starts[x[here]], level.starts[y[here]]
            same = level.symbols[a] == level.symbols[b]
            step = np.where(same, np.minimum(level.left(a), level.left(b)) if level.blocks else 1, 0)
            x[here], y[here] = a + step, b + step
        return x - origin

    @staticmethod
    def _climb(level, k, x, y, ended, live):
        """Move the pairs ``live`` to the next level, or note that they differ on this one."""
        symbols = level.symbols

        def alike(live):
            same = symbols[x[live]] == symbols[y[live]]
            ended[live[~same]] = k
            return live[same]

        live = alike(live)
        apart = live[~(level.at_start(x[live]) & level.at_start(y[live]))]
        if len(apart):
            a, b = x[apart], y[apart]
            step = np.minimum(level.left(a), level.left(b)) if level.blocks else 1
            x[apart], y[apart] = a + step, b + step
            if not level.blocks:  # past equal symbols both are at a start, or both inside a pair
                inside = alike(apart)
                inside = inside[~level.at_start(x[inside])]
                x[inside] += 1
                y[inside] += 1
            alike(apart[ended[apart] < 0])
            live = live[ended[live] < 0]
        x[live], y[live] = level.phrase[x[live]], level.phrase[y[live]]
        return live


def _blocks(now, separators, fresh, turn):
    head = np.ones(len(now), bool)
    head[1:] = now[1:] != now[:-1]
    return _named(now, head, fresh, lambda s, starts: np.diff(starts))


def _pairs(now, separators, fresh, turn):
    mixed = (now.astype(np.uint64) + np.uint64(turn * 0x51ED27)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    one = ((mixed * _MIX) >> np.uint64(63)).astype(bool)
    free = now >= separators
    left, right = one & free, ~one & free
    joined, other = left[:-1] & right[1:], right[:-1] & left[1:]
    if other.sum() > joined.sum():
        joined = other
    head = np.ones(len(now), bool)
    head[1:] = ~joined
    return _named(now, head, fresh, lambda s, starts: now[starts[1:] - 1])


def _named(now, head, fresh, second):
    """Phrase starts, names and the next free name: one symbol alone keeps its own."""
    starts = np.append(np.flatnonzero(head), len(now))
    names = now[starts[:-1]].copy()
    several = np.flatnonzero(np.diff(starts) > 1)
    if len(several):
        key = (names[several].astype(np.int64) << 32) | second(names, starts)[several]
        distinct, which = np.unique(key, return_inverse=True)
        names[several] = fresh + which
        fresh += len(distinct)
    return starts, names, fresh

"""A bidirectional FM-index over a delimited vocabulary, and search schemes for one error.

The index keeps the ranks of ``$w1$w2...$wk$`` and of its reversal. A word is searched from its middle:
one half is matched exactly up to the delimiter, with the intervals of both texts in step, then the
other half is matched outwards allowing one error. Words are sorted, so the rank of ``$w$`` names w.
All searches advance together, one symbol a step.
"""

from __future__ import annotations

import numpy as np

from dayloom.llm.fm_index import suffix_array

END, DELIMITER = 0, 1
TOGETHER = 4096  # searches that advance in step


class Ranks:
    """Occurrences before every place of the last column, for every symbol."""

    def __init__(self, text: np.ndarray, size: int):
        order = suffix_array(text, max(1, int(size).bit_length()))
        last = text[order - 1]
        self.before = np.zeros((len(text) + 1, size), np.int32)
        self.before[np.arange(1, len(text) + 1), last] = 1
        np.cumsum(self.before, axis=0, out=self.before)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])[:-1]
        self.order = order

    def children(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many suffixes of each interval every symbol precedes."""
        return self.before[low + size] - self.before[low]

    def step(self, low, size, symbol):
        down, up = self.before[low, symbol], self.before[low + size, symbol]
        return self.first[symbol] + down, up - down


class VariantIndex:
    def __init__(self, words: list[str]):
        """``words`` are distinct and sorted by code points."""
        letters = sorted(set().union(*words))
        self.code = {c: i + 2 for i, c in enumerate(letters)}
        self.size = len(letters) + 2
        self.words, self.known = words, set(words)
        text = self.encode(words)
        starts = np.flatnonzero(text == DELIMITER)[:-1]
        self.ahead = Ranks(np.append(text, END), self.size)
        self.behind = Ranks(np.append(text[::-1], END), self.size)
        # Rows of $word$ in either text: after those of the end and of the lone last delimiter.
        word = np.full(len(text) + 1, -1, np.int64)
        word[starts] = np.arange(len(words))
        self.by_ahead = word[self.ahead.order[2 : 2 + len(words)]]
        word[:] = -1
        closing = len(text) - 1 - np.flatnonzero(text == DELIMITER)[1:]
        word[closing] = np.arange(len(words))
        self.by_behind = word[self.behind.order[2 : 2 + len(words)]]

    def encode(self, words: list[str]) -> np.ndarray:
        """``$w1$w2...$wk$``; letters the vocabulary lacks become a symbol that matches nothing."""
        code = self.code
        flat = [DELIMITER]
        for w in words:
            flat += [code.get(c, -1) for c in w]
            flat.append(DELIMITER)
        return np.array(flat, np.int64)

    def near(self, queries: list[str], from_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word), both by number, at exactly one inserted, deleted or replaced letter.

        ``from_left``: the error is in the second half, with the first one matched exactly; else the
        error is in the first half only, so that the two calls part the pairs. Each is given once.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(queries), TOGETHER):
            q, w = self._near(queries[at : at + TOGETHER], from_left)
            found.append((q + at, w))
        q, w = (np.concatenate(x) for x in zip(*found, strict=True))
        if from_left or not len(q):
            return q, w
        other = [not self.words[b].startswith(a[: len(a) // 2]) for a, b in zip([queries[i] for i in q], w, strict=True)]
        return q[other], w[other]

    def _near(self, queries, from_left):
        flat = self.encode(queries)
        own = np.array([q in self.known for q in queries])
        starts = np.flatnonzero(flat == DELIMITER)
        begin, close = starts[:-1], starts[1:]  # the delimiters around every query
        middle = begin + 1 + (close - begin - 1) // 2  # the first letter of the second half
        # Outwards over the exact half, ranks of both texts in step.
        near_ranks, far_ranks = (self.ahead, self.behind) if from_left else (self.behind, self.ahead)
        place, stop, way = (middle - 1, begin, -1) if from_left else (middle, close, 1)
        place = place.copy()
        low = np.zeros(len(queries), np.int64)
        other = low.copy()
        size = np.full(len(queries), len(near_ranks.order), np.int64)
        live = np.arange(len(queries))
        while len(live):
            symbol = flat[place[live]]
            count = near_ranks.children(low[live], size[live])
            mine = np.where(symbol >= 0, np.take_along_axis(count, np.maximum(symbol, 0)[:, None], 1)[:, 0], 0)
            less = np.where(np.arange(self.size) < symbol[:, None], count, 0).sum(1)
            low[live] = near_ranks.first[np.maximum(symbol, 0)] + near_ranks.before[low[live], np.maximum(symbol, 0)]
            other[live] += less
            size[live] = mine
            done = place[live] == stop[live]
            place[live] += way
            live = live[(mine > 0) & ~done]
        # Inwards-out over the other half with one error; ``place`` runs to its delimiter.
        query = np.flatnonzero(size > 0)
        low, size = other[query], size[query]
        place = (middle if from_left else middle - 1)[query]
        way, edge = (1, close) if from_left else (-1, begin)
        hits = []
        wrong = [np.zeros(0, np.int64)] * 4  # searches that have made their error
        while len(query) or len(wrong[0]):
            wrong = self._exact(far_ranks, flat, wrong, way, edge, hits)
            some = (size > 1) | ~own[query]  # a single word left is the query itself, if that is one
            query, low, size, place = query[some], low[some], size[some], place[some]
            if not len(query):
                continue
            count = far_ranks.children(low, size)
            symbol = flat[place]
            inside = place != edge[query]
            odd = count > 0
            odd[:, : DELIMITER + 1] = False
            known = symbol > DELIMITER
            odd[np.flatnonzero(known), symbol[known]] = False
            row, letter = np.nonzero(odd)
            child_low = far_ranks.first[letter] + far_ranks.before[low[row], letter]
            child = [query[row], child_low, count[row, letter].astype(np.int64), place[row]]
            replaced = inside[row]
            more = [child, [x[replaced] for x in child[:3]] + [child[3][replaced] + way]]
            dropped = inside.copy()
            dropped[inside] = symbol[inside] != flat[place[inside] + way]
            more.append([query[dropped], low[dropped], size[dropped], place[dropped] + way])
            wrong = [np.concatenate(x) for x in zip(wrong, *more, strict=True)]
            # The exact continuation.
            go = inside & known
            query, place = query[go], place[go]
            low, size = far_ranks.step(low[go], size[go], symbol[go])
            place = place + way
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, row = (np.concatenate(x) for x in zip(*hits, strict=True))
        by = self.by_behind if from_left else self.by_ahead
        return query, by[row - 2]

    @staticmethod
    def _exact(ranks, flat, states, way, edge, hits):
        """One step of the searches that may not err again; complete words go to ``hits``."""
        query, low, size, place = states
        symbol = flat[place]
        known = symbol >= 0
        query, low, size, place, symbol = (x[known] for x in (query, low, size, place, symbol))
        low, size = ranks.step(low, size, symbol)
        alive = size > 0
        complete = alive & (place == edge[query])
        hits.append((query[complete], low[complete]))
        alive &= ~complete
        return [query[alive], low[alive], size[alive].astype(np.int64), place[alive] + way]

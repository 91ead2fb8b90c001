"""Order-preserving packing of documents into sequences by dynamic programming.

Documents keep their order. The token stream is cut into windows of at most ``length`` tokens, at the
end of a document (free), at the end of a sentence (``sentence_cost``, since it truncates a document)
or, inside a sentence longer than ``longest``, every ``longest`` tokens (``inner_cost``). The cuts
minimise the padding of all windows plus these costs:

    best(j) = cost(j) + length - end(j) + min over i of (best(i) + end(i)),  end(j) - end(i) <= length

The minimum over a sliding range of ends is the head of a monotone queue, so time is linear in the
number of possible cuts. A stream is solved over a horizon of ``horizon`` windows; all but the last
few of them are emitted and the rest is solved again with what follows, so memory is bounded.

Every input partition is a stream of its own, in the order of its rows: packing needs no shuffle, and
a lost executor repeats its partition with the same result. ``sequence_id`` is the partition number
times 2^40 plus the window's number in it.

Defined results: null and empty texts are documents of the end token alone; rows repeated whole are
packed each; an empty table gives no piece; a text of any length is split over as many windows as it
needs, and each of its tokens lies in exactly one piece.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dayloom.llm.rows import OUT_ROWS, chunks

LENGTH = 4096
END = 2
SENTENCE_COST = 8
INNER_COST = 24
LONGEST = 64
HORIZON = 96  # windows solved at a time
HELD = 16  # of them solved again with what follows
TOKENIZER = "word_bpe_49k.json"
MEMO_WORDS = 1 << 18
# Marks that close a word, behind a letter and before white space or the end.
_CLOSING = re.compile(rb"[!-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-/:-@\[-`{-~]*(?!\S)")
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_STOP = re.compile("[^A-Za-z0-9]*[.!?][^A-Za-z0-9]*</w>", re.ASCII)
# Byte-level vocabularies show a byte as itself where it prints, else as the next sign from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_HIDDEN = re.compile("[\x80-\xa0\xad]")  # of the bytes of Latin letters


class Tokens(dict):
    """Ids of words between white space as little-endian bytes, remembered for up to MEMO_WORDS.

    The vocabulary drops white space and never joins across it, so words can be encoded one by one.
    It also folds case and splits letters from closing marks, so ``words`` does both for whole texts:
    fewer words are to be remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        marks = [i for t, i in vocabulary.items() if _STOP.fullmatch(t)]
        self.closing[marks] = True
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode().lower() for t in added]

    def words(self, text: str) -> list[bytes]:
        """Words between white space, ASCII letters in lower case, marks that close a word by themselves.

        Texts with a special token of the vocabulary, in any case, keep their case and marks: such
        tokens are found in the text as it is.
        """
        plain = text.encode()
        low = plain.lower()
        if any(a in low for a in self.added):
            return plain.split()
        return _CLOSING.sub(rb" \g<0>", low).split()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self._forget()
        if word.isalpha() and word.islower():
            ids = self._letters(word.decode())
        else:
            ids = self._mixed(word)
        self[word] = ids
        return ids

    def _mixed(self, word: bytes) -> bytes:
        text = word.decode()
        if not _LATIN.fullmatch(text):
            return self._encoded(text)
        plain = text.lower().encode()
        if plain != word:
            return self[plain]
        shown = word.decode("latin-1")
        return self._letters(shown.translate(_VISIBLE) if _HIDDEN.search(shown) else shown)

    def _forget(self) -> None:
        """Drop the younger half: frequent words were met early."""
        old = dict(islice(self.items(), MEMO_WORDS // 2))
        self.clear()
        self.update(old)

    def _letters(self, shown: str) -> bytes:
        """Ids of lower-case Latin letters: one word to the vocabulary, so its model alone decides."""
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def tokens_and_cuts(text: str | None, tokens: Tokens, longest: int = LONGEST):
    """A document's ids with the end token as bytes, the ends of its pieces and whether each ends a
    sentence (the last one ends the document).

    A sentence ends with a word whose last token is a closing mark.
    """
    pieces = list(map(tokens.__getitem__, tokens.words(text))) if text else []
    ids = b"".join(pieces)
    size = len(ids) // 4
    edges = np.zeros(2, np.int64)
    if ids:
        after = np.cumsum(np.fromiter(filter(None, map(len, pieces)), np.int64)) // 4
        stops = after[:-1][tokens.closing[np.frombuffer(ids, "<u4")[after[:-1] - 1]]]
        edges = np.zeros(len(stops) + 2, np.int64)
        edges[1:-1] = stops
    edges[-1] = size
    stops, gaps = edges[1:-1], edges[1:] - edges[:-1]
    ends, whole = stops.tolist(), [True] * len(stops)
    for place in np.flatnonzero(gaps > longest)[::-1].tolist():  # sentences too long for one piece
        start = int(stops[place - 1]) if place else 0
        inner = list(range(start + longest, start + int(gaps[place]), longest))
        ends[place:place] = inner
        whole[place:place] = [False] * len(inner)
    return ids + np.array([END], "<u4").tobytes(), [*ends, size + 1], [*whole, True]


def best_cuts(ends: list[int], costs: list[int], length: int) -> list[int]:
    """Indexes into ``ends`` of the cheapest cuts; steps between ends are at most ``length``.

    The last end is always a cut. ``value`` is best + end, and ``queue`` holds places at which it grows
    from head to tail.
    """
    value = [0] * (len(ends) + 1)
    came = [0] * (len(ends) + 1)
    at = [0, *ends]
    queue = deque([0])
    for j in range(1, len(at)):
        first = at[j] - length
        while at[queue[0]] < first:
            queue.popleft()
        came[j] = i = queue[0]
        value[j] = new = value[i] + length + costs[j - 1]
        while queue and value[queue[-1]] >= new:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(ends)
    while j:
        cuts.append(j - 1)
        j = came[j]
    return cuts[::-1]


class _Stream:
    """Documents waiting to be packed: the rest of the first one and the whole of the others."""

    def __init__(self, length: int, first_id: int):
        self.length, self.sequence = length, first_id
        self.documents: deque = deque()
        self.size = 0

    def add(self, key, ids: bytes, ends: list[int], whole: list[bool]) -> None:
        self.documents.append((key, ids, ends, whole, 0))
        self.size += len(ids) // 4

    def windows(self, last: bool) -> Iterator[tuple]:
        """Pieces of the windows that are settled; all of them, if nothing follows."""
        ends, costs, base = [], [], 0
        for _, ids, cut, whole, start in self.documents:
            ends += [base + e - start for e in cut if e > start]
            costs += [SENTENCE_COST if w else INNER_COST for e, w in zip(cut, whole, strict=True) if e > start]
            costs[-1] = 0
            base += len(ids) // 4 - start
        if not ends:
            return
        cuts = [ends[i] for i in best_cuts(ends, costs, self.length)]
        for cut, before in zip(cuts if last else cuts[:-HELD], [0, *cuts], strict=False):
            left, offset = cut - before, 0
            while left:
                key, ids, marks, whole, start = self.documents[0]
                total = len(ids) // 4
                n = min(left, total - start)
                yield key, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, self.sequence, offset
                left, offset = left - n, offset + n
                self.size -= n
                if start + n == total:
                    self.documents.popleft()
                else:
                    self.documents[0] = (key, ids, marks, whole, start + n)
            self.sequence += 1


@lru_cache(1)
def _tokens(path: str) -> Tokens:
    """One tokenizer and one memo a worker. Tasks reach it through this module, so it outlives them."""
    return Tokens(path)


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    *,
    length: int = LENGTH,
    horizon: int = HORIZON,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    ``tokenizer_path`` is the tokenizer's file, to be found under that path by every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer_path)
        stream = _Stream(length, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        for table in chunks(batches, "text", 4 << 20):
            for key, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
                stream.add(key, *tokens_and_cuts(text, tokens, min(LONGEST, length)))
                if stream.size >= horizon * length:
                    rows.extend(stream.windows(False))
                    if len(rows) >= OUT_ROWS:
                        yield _pieces(rows)
                        rows = []
        rows.extend(stream.windows(True))
        if rows:
            yield _pieces(rows)

    return documents.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

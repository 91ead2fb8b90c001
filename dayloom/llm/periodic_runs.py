"""Periodic runs of words, found on run-length grammars of whole texts.

A run of period q and at least 4q words covers a multiple of 3q, together with the word q further on.
So all candidates are the pairs (i, i + q) with i on the grid of 3q, n/3q of them for a period and
n log n in all; where the two words are equal, extension queries on the grammars of the words and of
the reversed words (``recompression``) give the exact ends. Documents share a grammar in chunks of
about CHUNK_BYTES, a longer one has its own; separators keep them apart.

Every stretch is found under all multiples of its period and reported under the least.

Defined results: null, empty and wordless texts have no words, no run and the digests of nothing; a
null doc_id leaves the words as they are; repeated rows give repeated rows; further columns do not
matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dayloom.llm.recompression import Grammar
from dayloom.llm.rows import with_arrow_columns

TIMES = 4  # least number of periods in a run
LEAST = 6  # least number of words in a run
CHUNK_BYTES = 2 << 20
CANDIDATES = 1 << 20  # pairs looked at together


def candidates(ids: np.ndarray, offsets: np.ndarray, lengths: np.ndarray):
    """Arrays (i, q) of grid pairs with equal words, in slices of about CANDIDATES pairs.

    ``offsets`` and ``lengths`` place the texts in ``ids``; pairs stay inside a text.
    """
    periods = np.where(lengths >= LEAST, lengths // TIMES, 0)
    text = np.repeat(np.arange(len(lengths)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (lengths[text] - q - 1) // ((TIMES - 1) * q) + 1
    ends = np.cumsum(points)
    at = 0
    while at < len(q):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
        number = points[at:upto]
        period = np.repeat(q[at:upto], number)
        nth = np.arange(len(period)) - np.repeat(np.cumsum(number) - number, number)
        i = np.repeat(offsets[text[at:upto]], number) + nth * (TIMES - 1) * period
        equal = ids[i] == ids[i + period]
        yield i[equal], period[equal]
        at = upto


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of every list of words, by start, then period."""
    names: defaultdict = defaultdict()
    separators = len(texts) + 1
    names.default_factory = lambda: separators + len(names)
    stream, offsets = [np.zeros(1, np.int32)], []
    total = 1
    for k, words in enumerate(texts):
        offsets.append(total)
        stream += [np.fromiter(map(names.__getitem__, words), np.int32, len(words)), np.array([k + 1], np.int32)]
        total += len(words) + 1
    ids, offsets = np.concatenate(stream), np.array(offsets, np.int64)
    lengths = np.array([len(w) for w in texts], np.int64)
    found = []
    ahead = behind = None
    for i, q in candidates(ids, offsets, lengths):
        if not len(i):
            continue
        if ahead is None:
            ahead, behind = Grammar(ids, separators), Grammar(ids[::-1], separators)
        right = ahead.common(i, i + q)
        last = len(ids) - 1
        left = behind.common(last - (i - 1), last - (i + q - 1))
        length = left + right + q
        long = length >= np.maximum(LEAST, TIMES * q)
        found.append(np.stack([(i - left)[long], length[long], q[long]]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not found:
        return out
    start, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    of = np.searchsorted(offsets, start, "right") - 1
    for k in order:
        out[of[k]].append((int(start[k] - offsets[of[k]]), int(length[k]), int(q[k])))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return [words[i] for i in kept]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with the period that its id may plant."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def periodic_runs(documents: DataFrame, *, plant: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Documents (columns ``keep``, default all) with runs, an array of (start, length, period), and
    collapsed_text: the words outside the repetitions, joined by one space (null for a null text).

    ``plant`` first writes the period into a document that its doc_id calls for.
    """
    schema = "runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def find(table: pa.Table):
        texts, runs = _found(table, plant)
        keys = ("start", "length", "period")
        shorter = [b" ".join(collapsed(w, r)).decode() for w, r in zip(texts, runs, strict=True)]
        nulls = table.column("text").is_null().to_pylist()
        return [
            pa.array([[dict(zip(keys, r, strict=True)) for r in own] for own in runs], kind),
            pa.array([None if null else s for s, null in zip(shorter, nulls, strict=True)], pa.string()),
        ]

    return with_arrow_columns(documents, find, schema, size_of="text", keep=keep, chunk_bytes=CHUNK_BYTES)


def _found(table: pa.Table, plant: bool):
    texts = [t.encode().split() if t else [] for t in table.column("text").to_pylist()]
    if plant:
        texts = [planted(w, d) for w, d in zip(texts, table.column("doc_id").to_pylist(), strict=True)]
    return texts, runs_of(texts)


def runs_report(documents: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the longest one, digests of runs and kept words."""
    schema = (
        "n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )

    def report(table: pa.Table):
        rows = []
        for words, runs in zip(*_found(table, True), strict=True):
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
            kept = b" ".join(collapsed(words, runs))
            milli = 1000 * n // q if runs else None
            rows.append((len(runs), s, n, q, milli, _sha(listed.encode()), _sha(kept)))
        columns = list(zip(*rows, strict=True))
        return [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]

    found = documents.select("doc_id", "text")
    return with_arrow_columns(found, report, schema, size_of="text", keep=["doc_id"], chunk_bytes=CHUNK_BYTES)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

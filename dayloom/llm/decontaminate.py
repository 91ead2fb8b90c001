"""Benchmark decontamination with an FM-index per training shard.

Every shard (whole documents of about SHARD_BYTES) becomes one FM-index. All test windows are
searched backwards at once through wavelet-matrix ranks, the occurrences are located from sampled
suffix positions and merged into removal spans. The benchmark's vocabulary is the index alphabet:
any run of other words is one foreign symbol, which no window holds, so it only separates.

Defined results: a null, empty or wordless text has no words and no hits, an item without words has
no windows, a null item_id lends its windows but is not listed, equal item_ids are one item, rows
repeated in either table stay repeated or count once as windows. Columns of the result replace
documents' columns of the same name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.fm_index import FMIndex
from dayloom.llm.rows import with_arrow_columns
from dayloom.session import stage

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20  # of benchmark text in one index of windows
PASSES = 4  # blocks searched in one pass over the documents

# Words: digits, lower-case letters and everything beyond ASCII; all else separates.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class Windows:
    """Distinct word windows of benchmark items, with the items each comes from."""

    def __init__(self, items: list[tuple[object, bytes]], size: int = WINDOW):
        owners: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            got = words(text)
            for i in range(max(1, len(got) - size + 1) if got else 0):
                owners[tuple(got[i : i + size])].add(item)
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(chain.from_iterable(owners)))}
        self.owners = [sorted(str(x) for x in o if x is not None) for o in owners.values()]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.patterns = np.full((len(owners), size), -1, np.int64)
        for row, window in enumerate(owners):
            self.patterns[row, size - len(window) :] = [self.vocabulary[w] for w in window]

    def hits(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """Per text: number of words, the hit words' numbers, the items found."""
        known = self.vocabulary.get
        symbols = [
            np.fromiter((known(w, 0) for w in words(t)), np.int32) if t else np.zeros(0, np.int32)
            for t in texts
        ]
        counts = [len(s) for s in symbols]
        found = [(n, np.zeros(0, np.int64), set()) for n in counts]
        if not len(self.lengths) or not any(counts):
            return found
        stream = np.concatenate([x for s in symbols for x in (s, np.zeros(1, np.int32))])
        starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
        kept = np.ones(len(stream), bool)
        kept[1:] = (stream[1:] != 0) | (stream[:-1] != 0)
        places = np.flatnonzero(kept)  # of the indexed symbols in the stream of all words
        index = FMIndex(stream[kept], len(self.vocabulary))
        low, high = index.search(self.patterns)
        some = np.flatnonzero(high > low)
        if not len(some):
            return found
        times = (high - low)[some]
        rows = np.repeat(low[some] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        at = places[index.locate(rows)]
        which = np.repeat(some, times)
        edges = np.zeros(len(stream) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + self.lengths[which], -1)
        hit = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        of = np.searchsorted(starts, hit, "right") - 1
        for group in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(of)) + 1):
            d = of[group[0]]
            found[d] = (counts[d], hit[group] - starts[d], set())
        pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, which]), axis=1)
        for d, w in pairs.T:
            found[d][2].update(self.owners[w])
        return found


def removal_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of maximal runs of hit words."""
    bounds = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [(bounds[r[0]][0], bounds[r[-1]][1]) for r in runs if len(r)]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def benchmark_blocks(benchmark: DataFrame, block_bytes: int, size: int) -> Iterator[Windows]:
    """The benchmark in blocks of bounded size: one at least, and one at a time is read by the driver."""
    size_of = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total = benchmark.agg(F.sum(size_of)).first()[0] or 0
    blocks = total // block_bytes + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = benchmark.filter(F.col("text").isNotNull() & (part == k)).select("item_id", "text")
        yield Windows([(r[0], r[1].encode()) for r in rows.toLocalIterator()], size)


def _merged(parts: tuple) -> tuple[int, np.ndarray, set[str]]:
    """A text's number of words, hit words and items from those of several blocks."""
    return parts[0][0], np.unique(np.concatenate([p[1] for p in parts])), set().union(*(p[2] for p in parts))


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    clean: bool = True,
    keep: list[str] | None = None,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents (columns ``keep``, default all) with n_words, hit_words (their numbers, from 0),
    items and, if ``clean``, clean_text: the text without the spans of hit words.

    A benchmark larger than ``block_bytes`` is searched PASSES blocks a narrow pass; results are staged
    between passes, so that neither plan nor driver grows with it. A pass is one Arrow step, cleaning
    included: every further step in a stage would be another Python process for each running task.
    """
    result, first = documents, True
    kept = list(keep if keep is not None else documents.columns)
    kept += [c for c in ["text"] if c not in kept]
    schema = "n_words long, hit_words array<int>, items array<string>"
    blocks = benchmark_blocks(benchmark, block_bytes, window)
    ahead = next(blocks)
    while ahead is not None:
        if not first:
            result = stage(result, "searched")
        together, ahead = [ahead, *islice(blocks, PASSES - 1)], next(blocks, None)

        def search(table: pa.Table, together=together, first=first, cleaned=clean and ahead is None):
            texts = table.column("text").to_pylist()
            data = [t.encode() if t is not None else None for t in texts]
            found = [block.hits(data) for block in together]
            if not first:
                was = zip(*(table.column(c).to_pylist() for c in ("n_words", "hit_words", "items")), strict=True)
                found.append([(n, np.array(hit, np.int64), set(items)) for n, hit, items in was])
            merged = found[0] if len(found) == 1 else [_merged(parts) for parts in zip(*found, strict=True)]
            columns = [
                pa.array([f[0] for f in merged], pa.int64()),
                pa.array([f[1] for f in merged], pa.list_(pa.int32())),
                pa.array([sorted(f[2]) for f in merged], pa.list_(pa.string())),
            ]
            if cleaned:
                for i, (_, hit, _) in enumerate(merged):
                    if len(hit):
                        texts[i] = without(data[i], removal_spans(data[i], hit)).decode()
                columns.append(pa.array(texts, pa.string()))
            return columns

        added = f"{schema}, clean_text string" if clean and ahead is None else schema
        result = with_arrow_columns(result, search, added, size_of="text", keep=kept, chunk_bytes=shard_bytes)
        first = False
    return result if keep is None or "text" in keep else result.drop("text")


def decontamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items found and their digest."""
    found = decontaminate(documents.select("doc_id", "text"), benchmark, clean=False, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )

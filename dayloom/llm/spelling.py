"""Spelling variants: words one inserted, deleted or replaced letter apart, and the forms they follow.

A word is split in half. Whatever is near it has one half unchanged in its place, so it shares either
the first half as a prefix or the second half as a suffix. Each word is therefore dealt, as a query,
to the group of its first half and to that of its second one, and as a target to the groups that a
query of its length or one letter more or less could ask for. A task puts whole groups, up to
TOGETHER targets, into one bidirectional FM-index (``variant_index``) and searches all its queries
in step. Groups above BLOCK targets are cut into blocks by hash of the target, each with an index of
its own, and their queries go to every block: no group meets in one task.

Pairs never leave the index. A query leaves with the number of its near words and the best of them,
of either half, which add up since the two searches part the pairs.

Forms go up in frequency by a factor of RATIO at least, so a chain has at most log n / log RATIO links;
roots follow by doubling over so many rounds.

Defined results: null, empty and letterless texts have no words; a null doc_id reads as an empty
number; repeated rows count repeatedly; letters beyond the two Latin blocks end a run.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.rows import chunks
from dayloom.llm.variant_index import VariantIndex
from dayloom.session import stage

LETTERS = 6  # least length of a word; halves of shorter ones would fit too much
TIMES = 5  # least number of occurrences
RATIO = 5  # how many times as frequent a form has to be
SLIP = 199  # one in so many (document, run) pairs loses a letter
BLOCK = 16_384  # targets of one group that share an index
TOGETHER = 16_384  # targets of several groups that share one
CHUNK_BYTES = 4 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _runs(least: int):
    return re.compile(r"[a-zÀ-ÿ]{%d,}" % least)


def slipped(run: str, prefix: int) -> str:
    """``run`` of a document, without one letter where its digest says so.

    ``prefix`` is the crc32 of what precedes the run in the digested text.
    """
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(documents: DataFrame, *, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """(word, n): words of at least ``letters`` letters that occur at least ``times`` times.

    Counts are combined in every chunk of texts, then before the shuffle, then after it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(letters)
        for table in chunks(batches, "text", CHUNK_BYTES):
            total: Counter[str] = Counter()
            for doc_id, text in zip(*(table.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                own = Counter(runs.findall(text.encode().translate(_LOWER).decode()))
                for run, n in own.items():
                    total[slipped(run, prefix)] += n
            words = [w for w in total if len(w) >= letters]
            columns = [pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())]
            yield from pa.table(columns, names=["word", "n"]).to_batches(max_chunksize=1 << 16)

    counted = documents.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _dealt(words: DataFrame, letters: int, block: int) -> DataFrame:
    """Rows (left, half, block, blocks, word, n, target, query): who meets whom in which index."""
    length = F.char_length("word")
    lengths = F.filter(F.array(length - 1, length, length + 1), lambda k: k >= letters)  # of possible queries

    def halves(left: bool):
        of = lambda k: F.floor(k / 2).cast("int") if left else F.ceil(k / 2).cast("int")
        size = F.array_distinct(F.transform(lengths, of))
        part = lambda k: F.substring("word", F.lit(1), k) if left else F.substring("word", -k, k)
        return F.transform(
            size,
            lambda k: F.struct(F.lit(left).alias("left"), part(k).alias("half"), (k == of(length)).alias("query")),
        )

    rows = words.select("word", "n", F.explode(F.concat(halves(True), halves(False))).alias("to")).select("to.*", "word", "n")
    large = (
        rows.groupBy("left", "half").count().filter(F.col("count") > block)
        .select("left", "half", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    )
    rows = rows.join(large, ["left", "half"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    asked = F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return rows.withColumn("block", F.explode(asked)).withColumn("target", F.col("block") == own)


def near_words(words: DataFrame, *, letters: int = LETTERS, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """``words`` (word, n) with n_near and the near word of largest n, the first one of equals, as
    ``best`` and ``best_n`` (null without one). Words are distinct and of ``letters`` letters at least.
    """
    dealt = _dealt(words, letters, block)
    key = ["left", "half", "block"]
    met = dealt.repartition(*key).sortWithinPartitions("left", *key[1:])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, together):
            yield _searched(rows)

    schema = "word string, n long, n_near long, best_n long, best string"
    sides = met.select(*key, "blocks", "word", "n", "target", "query").mapInArrow(search, schema)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct(-F.col("best_n"), F.col("best").alias("best"))))
    return (
        sides.groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best"))
        .select("word", "n", "n_near", F.col("_best.best").alias("best"), (-F.col("_best.col1")).alias("best_n"))
    )


def _groups(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.Table]:
    """Tables of whole groups of one side with about ``together`` targets; a block stays alone."""
    waiting: list[pa.Table] = []
    held = 0
    key = lambda t, i: (t["left"][i].as_py(), t["half"][i].as_py(), t["block"][i].as_py())
    parts: list[pa.Table] = []  # of the group that goes on
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        number = np.zeros(table.num_rows, bool)
        for name in ("left", "half", "block"):
            codes = table[name].combine_chunks().dictionary_encode().indices.to_numpy()
            number[1:] |= codes[1:] != codes[:-1]
        cuts = [0, *np.flatnonzero(number).tolist(), table.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = table.slice(a, b - a)
            if parts and key(parts[0], 0) != key(part, 0):
                waiting, held, ready = _closed(parts, waiting, held, together)
                yield from ready
                parts = []
            parts.append(part)
    if parts:
        waiting, held, ready = _closed(parts, waiting, held, together)
        yield from ready
    if waiting:
        yield pa.concat_tables(waiting)


def _closed(parts, waiting, held, together):
    """What waits and what is ready once a group is complete."""
    ready = []
    size = sum(p.num_rows for p in parts)
    alone = parts[0]["blocks"][0].as_py() > 1
    if waiting and (alone or held + size > together or waiting[0]["left"][0] != parts[0]["left"][0]):
        ready.append(pa.concat_tables(waiting))
        waiting, held = [], 0
    if alone:
        ready.append(pa.concat_tables(parts))
    else:
        waiting, held = [*waiting, *parts], held + size
    return waiting, held, ready


def _searched(rows: pa.Table) -> pa.RecordBatch:
    """The queries among ``rows`` with what is near them among the targets."""
    words, counts = rows["word"].to_pylist(), rows["n"].to_pylist()
    is_target, is_query = rows["target"].to_pylist(), rows["query"].to_pylist()
    n_of = {w: n for w, n, t in zip(words, counts, is_target, strict=True) if t}
    targets = sorted(n_of)
    asked = {w: n for w, n, q in zip(words, counts, is_query, strict=True) if q}
    queries = list(asked)
    n_near = np.zeros(len(queries), np.int64)
    best_n: list = [None] * len(queries)
    best: list = [None] * len(queries)
    if targets and queries:
        q, w = VariantIndex(targets).near(queries, rows["left"][0].as_py())
        n = np.array([n_of[t] for t in targets], np.int64)
        np.add.at(n_near, q, 1)
        order = np.lexsort((w, -n[w], q))
        first = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
        for i in first:
            best_n[q[i]], best[q[i]] = int(n[w[i]]), targets[w[i]]
    columns = [
        pa.array(queries, pa.string()), pa.array(list(asked.values()), pa.int64()), pa.array(n_near, pa.int64()),
        pa.array(best_n, pa.int64()), pa.array(best, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_near", "best_n", "best"])


def spelling_variants(
    documents: DataFrame, *, letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO, block: int = BLOCK
) -> DataFrame:
    """word, form (the near word it is a variant of), root (the last form of its chain), n, n_near, form_n."""
    words = stage(word_counts(documents, letters=letters, times=times), "words")
    found = near_words(words, letters=letters, block=block)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = stage(
        found.select(
            "word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n")
        ),
        "variants",
    )
    roots = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = found.agg(F.max("form_n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(math.log(most, ratio) + 1))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = stage(
            roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots"
        )
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

"""MinHash near-duplicates with tensored banding.

Two collections of SIDE keys each are made from WIDTH minhashes per key; a table is a pair (i, j) of
them, so SIDE^2 tables cost 2 * SIDE * WIDTH minhashes instead of 2 * SIDE^2 * WIDTH. Two documents
meet in a table unless one whole collection disagrees: at similarity 0.85 that happens to one pair
in 14,000 and at 0.8 to one in 1,800, and a component is only torn if every other path between the two
is lost as well.

Equal shingle sets are one class from the start, so exact copies of any number cost one row. Links
between classes come in two passes and are always confirmed on the full sets:

1. star: every member of a bucket against the bucket's smallest class;
2. rest: the members of buckets that the confirmed links leave in different components, gathered by
   hub (a large group in pairs of blocks). Inside a task pairs are found by rare common shingles
   and confirmed there; only links that join components leave it. Groups of thousands of copies,
   similar enough or not, never list all pairs.

Before texts are fetched in pass 1, a pair is dropped when fewer than MATCHES of its 32 minhashes
agree or its set sizes alone rule out the similarity; the first happens to a pair at the threshold
with a chance of 1e-8 at 0.85 and 1.2e-6 at 0.8 (binomial tails). Pass 2 is exact.

``percent`` is the smallest similarity of a link; SIDE, WIDTH and MATCHES are chosen for 80 and more.

Defined results: null or wordless texts have no shingles, link with nothing and are their own
component; a text of fewer words than a shingle is one shingle; rows repeated whole stay repeated,
each with the same result; links of any text of a repeated doc_id are links of that doc_id; a null
doc_id takes no part, has a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.components import components
from dayloom.llm.rows import with_arrow_columns
from dayloom.llm.sieve import matching, without
from dayloom.session import clear_staged, stage

SHINGLE = 5
PERCENT = 85  # unless the caller says otherwise
SIDE = 8
WIDTH = 2
MINHASHES = 2 * SIDE * WIDTH
MATCHES = 14
BLOCK = 512  # members of a group compared with as many others in one task, or fewer:
BLOCK_BYTES = 4 << 20  # of their texts on average

_ODD = np.random.default_rng(20240229).integers(0, 2**63, MINHASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(20240301).integers(0, 2**63, MINHASHES, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are split at ASCII white space after lower-casing A-Z; a word's hash enters a shingle's
    hash with the power of its place, so the order of words counts.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = total * _BASE + hashes[k : len(words) - size + 1 + k]
    return np.unique(_mixed(total ^ np.uint64(size)))


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the smallest value under each of MINHASHES affine maps."""
    least = np.full(MINHASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        for k in range(MINHASHES):
            least[k] = min(least[k], (part * _ODD[k] + _ADD[k]).min())
    return (least >> np.uint64(32)).astype(np.uint32)


def table_keys(signs: np.ndarray) -> np.ndarray:
    """(documents, side^2) keys from a (documents, 2 * side * width) matrix of minhashes."""
    halves = np.zeros((len(signs), 2, SIDE), np.uint64)
    parts = signs.reshape(len(signs), 2, SIDE, WIDTH).astype(np.uint64)
    for k in range(WIDTH):
        halves = _mixed(halves * _BASE + parts[:, :, :, k] + np.uint64(1))
    tables = np.arange(SIDE * SIDE, dtype=np.uint64) + np.uint64(1)
    pairs = halves[:, 0, :, None] * _BASE + halves[:, 1, None, :]
    return _mixed(pairs.reshape(len(signs), -1) + tables * _BASE)


def _signed(table: pa.Table):
    counts, low, high, signs = [], [], [], []
    for text in table.column("text").to_pylist():
        found = shingles(text)
        counts.append(len(found))
        digest = xxhash.xxh3_128_intdigest(found.tobytes()) if len(found) else None
        low.append(None if digest is None else (digest & (2**64 - 1)) - 2**63)
        high.append(None if digest is None else (digest >> 64) - 2**63)
        signs.append(minhashes(found).tobytes() if len(found) else None)
    return [
        pa.array(counts, pa.int64()),
        pa.array(low, pa.int64()),
        pa.array(high, pa.int64()),
        pa.array(signs, pa.binary()),
    ]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            signs = np.frombuffer(b"".join(part.column("signs").to_pylist()), np.uint32)
            keys = table_keys(signs.reshape(-1, MINHASHES))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel().view(np.int64)),
                    pa.array(np.repeat(part.column("class").to_numpy(), keys.shape[1])),
                ],
                names=["key", "class"],
            )


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted distinct sets share at least ``percent`` of their union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    left, known = None, np.zeros(0, np.uint64)
    for batch in batches:
        found = []
        for i in range(batch.num_rows):
            text = batch.column("text_a")[i].as_py()
            if text != left:
                left, known = text, shingles(text)
            found.append(linked(known, shingles(batch.column("text_b")[i].as_py()), percent))
        yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda batches: _confirmed(batches, percent), "a long, b long")


def _alike(n_a, signs_a, n_b, signs_b, percent: int) -> np.ndarray:
    sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sized & ((signs_a == signs_b).sum(axis=1) >= MATCHES)


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, MINHASHES)


def _alike_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        signs_a, signs_b = (_signs(batch.column(c).to_pylist()) for c in ("signs_a", "signs_b"))
        yield batch.select(["a", "b"]).filter(pa.array(_alike(n_a, signs_a, n_b, signs_b, percent)))


def similar_pairs(sets: list[np.ndarray], allowed=None, percent: int = PERCENT) -> np.ndarray:
    """Pairs (i < j) of sorted distinct sets that may share ``percent`` of their union, by prefixes.

    Tokens are ordered by how few of the sets hold them. Two similar sets have a common token among
    the first n - ceil(percent * n) + 1 of either, and at the first common one enough tokens still
    follow in both; pairs without such a token are not similar. ``allowed(i, j)`` may rule out more.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    none = np.zeros((0, 2), np.int64)
    if len(sets) < 2 or not sizes.any():
        return none
    tokens = np.concatenate(sets)
    by = np.argsort(tokens, kind="stable")
    tokens = tokens[by]
    number = np.zeros(len(tokens), np.int32)
    np.cumsum(tokens[1:] != tokens[:-1], out=number[1:])
    del tokens
    counts = np.bincount(number)
    order = np.empty(len(counts), np.int32)
    order[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    # Set and token in one number: sorted in place, without indexes beside it.
    both = np.repeat(np.arange(len(sets)), sizes)[by] << 32
    del by
    both |= order[number]
    del number
    both.sort()
    owner, token = (both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32)
    del both
    starts = np.cumsum(sizes) - sizes
    end = starts + sizes + (-percent * sizes) // 100 + 1  # of the prefixes
    kept = np.flatnonzero((token >= (counts == 1).sum()) & (np.arange(len(owner)) < end[owner]))
    kept = kept[np.argsort(token[kept], kind="stable")]
    found = [none]
    for group in np.split(kept, np.flatnonzero(np.diff(token[kept])) + 1):
        if len(group) < 2:
            continue
        who = owner[group]
        rest = sizes[who] - (group - starts[who])
        for k in range(len(group) - 1):
            other = who[k + 1 :]
            # |a & b| >= percent / (100 + percent) * (|a| + |b|) is the similarity in terms of sizes.
            needed = percent * (sizes[who[k]] + sizes[other])
            near = (100 + percent) * np.minimum(rest[k], rest[k + 1 :]) >= needed
            if allowed is not None:
                near &= allowed(who[k], other)
            if near.any():
                found.append(np.stack([np.full(near.sum(), who[k]), other[near]], axis=1))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def _links_within(table: pa.Table, percent: int) -> pa.Table:
    """Links that join different components within a group of texts: a spanning forest of them."""
    sets = [shingles(t.as_py()) for t in table.column("text")]
    ids, parts = table.column("class").to_pylist(), table.column("part").to_numpy()
    blocks = table.column("block").to_numpy()
    across = len(set(blocks.tolist())) > 1
    root = {p: p for p in parts.tolist()}

    def top(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    def allowed(i: int, others: np.ndarray) -> np.ndarray:
        apart = parts[others] != parts[i]
        return apart & (blocks[others] != blocks[i]) if across else apart

    out = []
    for i, j in similar_pairs(sets, allowed, percent):
        a, b = top(int(parts[i])), top(int(parts[j]))
        if a != b and linked(sets[i], sets[j], percent):
            root[a] = b
            out.append((ids[i], ids[j]))
    return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _blocks(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, blocks): into how many blocks a group is dealt, by its members and the bytes of their texts."""
    sized = groups.join(texts.select("doc_id", "size"), groups["class"] == texts["doc_id"])
    needed = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_BYTES)
    return sized.groupBy("hub").agg(F.ceil(needed).alias("blocks"))


def _rest(members: DataFrame, texts: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links within the buckets that still hold several components.

    Members of a bucket share its hub, so they are gathered once by hub instead of once a bucket; a
    large group is dealt out in pairs of blocks, of few members where their texts are long.
    """
    placed = members.join(parts, members["class"] == parts["node"], "left").select(
        "key", "hub", "class", F.coalesce("component", "class").alias("part")
    )
    spread = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    groups = stage(
        placed.join(spread.filter("low < high").select("key"), "key").select("hub", "class", "part").distinct(),
        "groups",
    )
    dealt = groups.join(_blocks(groups, texts), "hub").select(
        "hub",
        "class",
        "part",
        F.pmod(F.xxhash64("class"), "blocks").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"),
    )
    tasks = dealt.join(texts, dealt["class"] == texts["doc_id"]).select(
        "hub",
        F.least("block", "other").alias("x"),
        F.greatest("block", "other").alias("y"),
        "class",
        "part",
        "block",
        "text",
    )
    return tasks.groupBy("hub", "x", "y").applyInArrow(lambda table: _links_within(table, percent), "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id, kept.

    Documents link that share at least ``percent`` of their shingles.
    """
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    signed = stage(
        with_arrow_columns(
            documents,
            _signed,
            "n_shingles long, low long, high long, signs binary",
            size_of="text",
            keep=["doc_id"],
        ),
        "signed",
    )
    taking_part = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    named = (
        taking_part.groupBy("low", "high", F.col("n_shingles").alias("n"), "signs")
        .agg(F.min("doc_id").alias("class"))
    )
    named = stage(named, "classes")
    classes = named.select("class", "n", "signs")
    repeated = taking_part.groupBy("doc_id").count().filter("count > 1").select("doc_id")

    keys = classes.select("class", "signs").mapInArrow(_keyed, "key long, class long")
    shared = keys.groupBy("key").agg(F.min("class").alias("hub"), F.max("class").alias("top"))
    members = stage(
        keys.join(shared.filter("hub < top").drop("top"), "key").select("key", "class", "hub"), "members"
    )
    a, b = (classes.select(*[F.col(c).alias(f"{c}_{x}") for c in classes.columns]) for x in "ab")
    star = members.select(F.col("hub").alias("class_a"), F.col("class").alias("class_b")).distinct()
    star = star.filter("class_a < class_b").join(a, "class_a").join(b, "class_b")
    star = star.withColumnsRenamed({"class_a": "a", "class_b": "b"})
    star = stage(star.mapInArrow(lambda batches: _alike_pairs(batches, percent), "a long, b long").distinct(), "star")
    # The texts of classes that share a bucket with another one are fetched once.
    met = members.select(F.col("class").alias("doc_id")).distinct()
    texts = matching(documents, met, "doc_id")
    if not repeated.isEmpty():
        once = texts.join(repeated, "doc_id", "left_semi").dropDuplicates()
        texts = texts.join(repeated, "doc_id", "left_anti").unionByName(once)
    texts = stage(texts.withColumn("size", F.octet_length("text").cast("long")), "texts")
    links = stage(_confirm(star, texts, percent), "links")
    parts = components(links)
    more = stage(_rest(members, texts, parts, percent), "links")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    clear_staged(spark, members, star, texts, links, more)

    linked_rows = (
        signed.drop("signs")
        .join(named.select("low", "high", "class"), ["low", "high"], "left")
        .join(parts, F.col("class") == F.col("node"), "left")
    )
    component = F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id")
    )
    return linked_rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``documents`` without near-duplicates: of each component the row of its smallest doc_id.

    Of rows repeated with that doc_id one stays; rows without a doc_id stay.
    """
    found = stage(near_duplicates(documents, percent).select("doc_id", "kept"), "kept")
    once = without(documents, found.filter("NOT kept").select("doc_id").distinct(), "doc_id")
    many = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    many = many.select("doc_id")
    if not many.isEmpty():
        repeated = matching(once, many, "doc_id").dropDuplicates(["doc_id"])
        once = without(once, many, "doc_id").unionByName(repeated)
    return once

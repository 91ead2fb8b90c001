"""Exact top-k by inner product with a pivot-distance index.

Components are floor(scale * x). Inner products become distances by one more coordinate: with M the
largest norm, v' = (v, sqrt(M^2 - |v|^2)) and q' = (q, 0), so |q' - v'|^2 = |q|^2 + M^2 - 2 q.v and the
highest score is the nearest vector. Pivots are chosen from a sample of at most SAMPLE vectors
(smallest hashed content); every vector is keyed by its nearest pivot and its distance from it, and the
sorted keys are cut into blocks (annuli) of at most BLOCK vectors.

A query's k-th best score bounds its radius r, at first the one within the sample. By the triangle
inequality |d(q, p) - d(v, p)| <= r for whatever is nearer than r, so an annulus is as far from a query
as its distances are from d(q, p). Annuli are visited in the order of that bound: FIRST of them, then
SPREAD times as many in each round. After a round the radius shrinks to the k-th best score found so
far; annuli beyond it are never visited, and a query stops when none is left inside. Within a visited
annulus only the ring of possible vectors is scored. Bounds carry a slack for rounding, scores are
exact integers, so the result is exact. Queries are dealt by nearest pivot and distance and meet
blocks in blocks of QUERIES.

Equal vectors are one entry with their k + 1 smallest ids: a larger id can never be among the k best of
any query, since k others with the same score precede it.

Defined results: null vectors and vectors with a null or non-finite component take no part, nor do
null ids; rows with equal vec_id and vector are one, a vec_id with several vectors is a candidate and a
query with each of them (never a candidate of its own id); vectors are compared by the components
both have; empty vectors score 0; scores beyond a long are cut to its range; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.session import clear_staged, stage

SCALE = 1024
K = 10
SAMPLE = 2048
PIVOTS = 32
BLOCK = 4096
QUERIES = 512
FIRST = 4  # annuli that a block of queries visits in the first round
SPREAD = 4  # how many times as many in the next one
_EXACT = 2.0**53
_LONG = np.iinfo(np.int64)


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector) of the rows that take part; rows repeated whole are one."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select("vec_id", F.transform(value, lambda x: F.floor(x * scale).cast("long")).alias("vector"))
        .distinct()
    )


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _unpack(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(-1, dim) if dim else np.zeros((len(blob), 0), np.int64)


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products, through floating point only where every sum fits it."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    bound = float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1]
    if bound < _EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, int(_LONG.min), int(_LONG.max)).astype(np.int64)


class Space:
    """Distances in the augmented space, from pivots to vectors and queries."""

    def __init__(self, sample: np.ndarray, norm2: float, pivots: int = PIVOTS):
        self.norm2 = norm2
        self.dim = sample.shape[1]
        points = self._augmented(sample)
        chosen = [0] if len(points) else []
        far = ((points - points[chosen[:1]]) ** 2).sum(axis=1)
        while chosen and len(chosen) < pivots and far.max() > 0:  # farthest from those chosen
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        self.pivots = points[chosen]

    def _augmented(self, vectors: np.ndarray) -> np.ndarray:
        flat = vectors.astype(np.float64)
        rest = np.sqrt(np.maximum(self.norm2 - (flat**2).sum(axis=1), 0))
        return np.concatenate([flat, rest[:, None]], axis=1)

    def _from_pivots(self, points: np.ndarray) -> np.ndarray:
        squares = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)
        return np.sqrt(np.maximum(squares - 2 * points @ self.pivots.T, 0))

    def vectors(self, vectors: np.ndarray) -> np.ndarray:
        return self._from_pivots(self._augmented(vectors))

    def queries(self, queries: np.ndarray) -> np.ndarray:
        flat = queries.astype(np.float64)
        return self._from_pivots(np.concatenate([flat, np.zeros((len(flat), 1))], axis=1))

    def radius(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Distance within which all vectors of at least the score ``least`` lie, with slack."""
        squares = (queries.astype(np.float64) ** 2).sum(axis=1) + self.norm2 - 2 * least
        return np.sqrt(np.maximum(squares, 0)) * (1 + 1e-6) + self.slack

    @property
    def slack(self) -> float:
        # Distances come from squares of about norm2 with relative rounding of 1e-16 * dim.
        return 1e-6 * (1 + self.norm2**0.5)


def _kth(found: np.ndarray, ids: list, own: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the sample's other ids; -inf if there are fewer."""
    out = np.full(len(found), -np.inf)
    flat = np.array([(i, x) for i, group in enumerate(ids) for x in group], np.int64).reshape(-1, 2)
    for q in range(len(found)):
        some = found[q][flat[flat[:, 1] != own[q], 0]]
        if len(some) >= k:
            out[q] = np.partition(some, len(some) - k)[len(some) - k]
    return out


def best_of(row: np.ndarray, ids: list, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one query, ties to smaller ids; ``ids`` are ascending per vector."""
    if len(row) > k + 1:
        least = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
        tied = np.flatnonzero(row == least)
        if len(tied) > k + 1:
            firsts = np.array([ids[i][0] for i in tied])
            tied = tied[np.argsort(firsts, kind="stable")[: k + 1]]
        picked = np.concatenate([np.flatnonzero(row > least), tied])
    else:
        picked = np.arange(len(row))
    found = sorted((-int(row[i]), x) for i in picked for x in ids[i] if x != own)
    return [(-s, x) for s, x in found[:k]]


def top_k(embeddings: DataFrame, *, k: int = K, every: int = 100, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best others of every row whose id ``every`` divides."""
    spark = embeddings.sparkSession
    rows = stage(integer_vectors(embeddings, scale), "vectors")
    smallest = W.partitionBy("vector").orderBy("vec_id")
    classes = (
        rows.withColumn("place", F.row_number().over(smallest))
        .filter(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    classes = stage(classes, "classes")
    norm2 = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    summary = classes.agg(F.max(norm2).alias("norm2"), F.max(F.size("vector")).alias("dim")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if summary["dim"] is None:
        return spark.createDataFrame([], empty)
    dim = summary["dim"]
    sample = classes.orderBy(F.xxhash64("vector"), F.col("ids")[0]).limit(SAMPLE).collect()
    sample_ids = [list(r["ids"]) for r in sample]
    sample_vectors = np.zeros((len(sample), dim), np.int64)
    for i, r in enumerate(sample):
        sample_vectors[i, : len(r["vector"])] = r["vector"]
    space = Space(sample_vectors, summary["norm2"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = space.vectors(_matrix(batch.column("vector"), dim))
            nearest = distances.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest, pa.int32()), pa.array(distances[np.arange(len(nearest)), nearest])],
                names=["vector", "ids", "pivot", "distance"],
            )

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal number, held
            vectors = np.concatenate([h[0] for h in held])
            distances = np.concatenate([h[1] for h in held])
            row = {
                "block": number,
                "pivot": int(held[0][3]),
                "low": float(distances[0]),
                "high": float(distances[-1]),
                "vectors": vectors.tobytes(),
                "distances": distances.tobytes(),
                "ids": [x for h in held for x in h[2]],
            }
            number, held = number + 1, []
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in batches:
            pivots = batch.column("pivot").to_numpy()
            distances = batch.column("distance").to_numpy()
            vectors, ids = _matrix(batch.column("vector"), dim), batch.column("ids").to_pylist()
            at = 0
            while at < len(pivots):
                size = sum(len(h[0]) for h in held)
                if held and (held[0][3] != pivots[at] or size >= BLOCK):
                    yield block()
                    size = 0
                end = at + int(np.searchsorted(pivots[at:], pivots[at], "right"))
                end = min(end, at + BLOCK - size)
                held.append((vectors[at:end], distances[at:end], ids[at:end], pivots[at]))
                at = end
        if held:
            yield block()

    blocks = (
        classes.mapInArrow(keyed, "vector array<long>, ids array<long>, pivot int, distance double")
        .withColumn("first_id", F.col("ids")[0])
        .repartitionByRange("pivot", "distance", "first_id")
        .sortWithinPartitions("pivot", "distance", "first_id")
        .mapInArrow(
            blocked,
            "block long, pivot int, low double, high double, vectors binary, distances binary, ids array<array<long>>",
        )
    )
    blocks = stage(blocks, "blocks")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                vectors, own = _matrix(part.column("vector"), dim), part.column("vec_id").to_numpy()
                radius = space.radius(vectors, _kth(scores(vectors, sample_vectors), sample_ids, own, k))
                row = {"queries": number, "query_ids": own.tobytes(), "query_vectors": vectors.tobytes(), "radius": radius.tobytes()}
                yield pa.RecordBatch.from_pylist([row | _rings(space, vectors, radius)], schema=_QUERIES)
                number += 1

    wanted = rows.filter(F.col("vec_id") % every == 0)
    parts = int(wanted.count() // QUERIES + 1)
    near = wanted.select("vector", F.array("vec_id").alias("ids")).mapInArrow(
        keyed, "vector array<long>, ids array<long>, pivot int, distance double"
    )
    order = ["pivot", "distance", "vec_id"]
    asking = (
        near.select("vector", F.col("ids")[0].alias("vec_id"), "pivot", "distance")
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
    )
    queries = stage(asking.mapInArrow(asked, _QUERY_ROW), "queries")
    directory = stage(blocks.select("block", "pivot", "low", "high"), "directory")
    seen, best, number = None, None, FIRST
    while True:
        rings = queries.select("queries", F.posexplode("rings").alias("pivot", "ring"))
        bound = F.greatest(
            F.lit(0.0), F.col("low") - F.col("ring.until"), F.col("ring.since") - F.col("high")
        )  # of the whole block of queries; each query has its own when the annulus is scored
        pairs = (
            rings.join(directory, "pivot")
            .filter("low <= ring.to AND high >= ring.from")
            .select("queries", "block", bound.alias("bound"))
        )
        if seen is not None:
            pairs = pairs.join(seen, ["queries", "block"], "left_anti")
        place = F.row_number().over(W.partitionBy("queries").orderBy("bound", "block"))
        now = stage(pairs.withColumn("_place", place).filter(F.col("_place") <= number).select("queries", "block"), "pairs")
        if now.isEmpty():
            break
        both = now.join(queries.drop("rings"), "queries").join(blocks.drop("low", "high"), "block").drop("block")
        found = both.mapInArrow(lambda batches: _searched(batches, space, dim, k), _FOUND)
        if best is not None:
            found = found.unionByName(best)
        ranked = W.partitionBy("queries", "slot").orderBy(F.desc("score"), "vec_id")
        kept = found.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k).drop("_rank")
        best = stage(kept, "found")
        seen = now if seen is None else stage(seen.unionByName(now), "seen")
        least = best.groupBy("queries", "slot").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        known = least.filter(F.col("n") == k).groupBy("queries").agg(F.collect_list(F.struct("slot", "least")).alias("found"))
        queries = stage(
            queries.join(known, "queries", "left").mapInArrow(lambda batches: _shrunk(batches, space, dim), _QUERY_ROW),
            "queries",
        )
        number *= SPREAD
    if best is None:
        return spark.createDataFrame([], empty)
    clear_staged(spark, rows, classes, blocks, directory, queries, seen)
    # Rows of one query_id with several vectors are one query in the result.
    best = best.select("query_id", "vec_id", "score")
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _rings(space: Space, vectors: np.ndarray, radius: np.ndarray) -> dict:
    """By pivot: distances that can hold results of a block of queries, and those of the queries themselves."""
    away = space.queries(vectors)
    ends = zip(
        (away - radius[:, None]).min(axis=0).tolist(),
        (away + radius[:, None]).max(axis=0).tolist(),
        away.min(axis=0).tolist(),
        away.max(axis=0).tolist(),
        strict=True,
    )
    return {"rings": [{"from": a, "to": b, "since": c, "until": d} for a, b, c, d in ends]}


def _shrunk(batches: Iterator[pa.RecordBatch], space: Space, dim: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries with the radius of their k-th best score so far."""
    for batch in batches:
        for row in batch.to_pylist():
            radius = np.frombuffer(row["radius"]).copy()
            vectors = np.frombuffer(row["query_vectors"], np.int64).reshape(len(radius), dim)
            found = row.pop("found") or []
            slots = np.array([f["slot"] for f in found], np.int64)
            least = np.array([f["least"] for f in found], np.float64)
            radius[slots] = np.minimum(radius[slots], space.radius(vectors[slots], least))
            row |= {"radius": radius.tobytes()} | _rings(space, vectors, radius)
            yield pa.RecordBatch.from_pylist([row], schema=_QUERIES)


def _searched(batches: Iterator[pa.RecordBatch], space: Space, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of every query among each annulus it visits, ring by ring."""
    for batch in batches:
        for row in batch.to_pylist():
            vectors, own = _unpack(row["vectors"], dim), np.frombuffer(row["query_ids"], np.int64)
            queries = np.frombuffer(row["query_vectors"], np.int64).reshape(len(own), dim)
            distances = np.frombuffer(row["distances"])
            if not dim:
                vectors = np.zeros((len(distances), 0), np.int64)
            radius = np.frombuffer(row["radius"])
            at = space.queries(queries)[:, row["pivot"]]
            first = np.searchsorted(distances, at - radius, "left")
            last = np.searchsorted(distances, at + radius, "right")
            live = np.flatnonzero(first < last)
            if not len(live):
                continue
            low, high = first[live].min(), last[live].max()
            found = scores(queries[live], vectors[low:high])
            out = []
            for i, q in enumerate(live):
                ring = slice(first[q] - low, last[q] - low)
                ids = row["ids"][first[q] : last[q]]
                got = best_of(found[i][ring], ids, int(own[q]), k)
                out += [(row["queries"], int(q), int(own[q]), x, s) for s, x in got]
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["queries", "slot", "query_id", "vec_id", "score"])


_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("pivot", pa.int32()),
        ("low", pa.float64()),
        ("high", pa.float64()),
        ("vectors", pa.binary()),
        ("distances", pa.binary()),
        ("ids", pa.list_(pa.list_(pa.int64()))),
    ]
)
_QUERIES = pa.schema(
    [
        ("queries", pa.int64()),
        ("query_ids", pa.binary()),
        ("query_vectors", pa.binary()),
        ("radius", pa.binary()),
        ("rings", pa.list_(pa.struct([(n, pa.float64()) for n in ("from", "to", "since", "until")]))),
    ]
)
_QUERY_ROW = (
    "queries long, query_ids binary, query_vectors binary, radius binary, "
    "rings array<struct<from:double,to:double,since:double,until:double>>"
)
_FOUND = "queries long, slot long, query_id long, vec_id long, score long"

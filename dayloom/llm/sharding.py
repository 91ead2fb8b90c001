"""Consistent hashing with bounded loads, from DataFrame functions only.

The ring has ``CELLS`` places. Every shard owns ``replicas`` virtual nodes, and a key belongs to the
first node at or after its own place. Each shard has a quota; what overflows a full shard continues
clockwise to the next other shard, in rounds, until everything has a place. The quotas add up to all
rows and differ by at most one, so counts are balanced exactly, and a key leaves its home only where
the home is full.

Only row counts by node reach the driver: ``shards * replicas`` numbers. They decide which ranks of
each node's rows go to which shard. Rows are ranked within (node, sub-range of a hash, piece of the
input), so that a key with any share of the rows is ranked by many tasks; rows that are equal in all
columns are one row with a count until the end.

Defined results: rows are ranked by content, equal rows are interchangeable; null keys share one place
of the ring; a null text has size 16 and the checksum 0 of no bytes; an empty table gives no rows; if
there are fewer rows than shards, some shards are empty. Only ``doc_id``, ``text`` and ``carry`` are
read, and the result's columns win over ``carry`` of the same name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.llm.rows import utf8_bytes
from dayloom.session import stage

SHARDS = 40
REPLICAS = 64
CELLS = 1 << 16
SUBRANGES = 256
PIECES = 64
OVERHEAD = 16  # bytes of a row besides its text


def nodes(shards: int, replicas: int = REPLICAS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes clockwise, one a cell (the smallest digest stays)."""
    placed: dict[int, tuple[bytes, int]] = {}
    for shard in range(shards):
        for replica in range(replicas):
            digest = hashlib.sha256(f"{shard}/{replica}".encode()).digest()
            cell = int.from_bytes(digest[:8], "big") % CELLS
            placed[cell] = min(placed.get(cell, (digest, shard)), (digest, shard))
    return [(cell, shard) for cell, (_, shard) in sorted(placed.items())]


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flow(ring: list[tuple[int, int]], counts: dict[int, int], room: Sequence[int]) -> list[dict]:
    """Where each node's rows go: segments of their ranks with a shard and its first slot.

    In round k every node sends what is left to the k-th shard clockwise from it that it has not
    tried yet, which takes what it has room for; nodes are served clockwise.
    """
    load = [0] * len(room)
    waiting = [(n, 0, n, frozenset()) for n in range(len(ring)) if counts.get(n)]
    segments = []
    while waiting:
        later = []
        for node, done, at, tried in waiting:
            while ring[at][1] in tried:
                at = (at + 1) % len(ring)
            shard = ring[at][1]
            taken = min(room[shard] - load[shard], counts[node] - done)
            if taken:
                segments.append(
                    {"node": node, "first": done, "until": done + taken, "shard": shard, "slot": load[shard], "home": not tried}
                )
                load[shard] += taken
            if done + taken < counts[node]:
                later.append((node, done + taken, at, tried | {shard}))
        waiting = later
    return segments


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of bounded size from values held in the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard_rows(
    documents: DataFrame,
    shards: int = SHARDS,
    *,
    replicas: int = REPLICAS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, size, text_crc32, carry, home_shard, shard, slot) of every row."""
    spark = documents.sparkSession
    ring = nodes(shards, replicas)
    names = {"doc_id", "size", "text_crc32", "home_shard", "shard", "slot"}
    carried = [c for c in carry if c.lower() not in names]
    measured = documents.select(
        "doc_id",
        (utf8_bytes() + OVERHEAD).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        *carried,
    )
    content = ["doc_id", "size", "text_crc32", *carried]
    distinct = measured.groupBy(*content, F.pmod(F.spark_partition_id(), F.lit(PIECES)).alias("_piece")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    starts = [-1, *[cell for cell, _ in ring[:-1]]]
    spans = [
        {"_node": n, "_home": shard, "_from": starts[n] + 1, "_to": cell} for n, (cell, shard) in enumerate(ring)
    ]
    spans.append({"_node": 0, "_home": ring[0][1], "_from": ring[-1][0] + 1, "_to": CELLS - 1})
    spans = [s for s in spans if s["_from"] <= s["_to"]]
    cells = _table(spark, spans, "_node int, _home int, _from int, _to int").select(
        "_node", "_home", F.explode(F.sequence(F.col("_from").cast("long"), F.col("_to").cast("long"))).alias("_cell")
    )
    mixed = F.pmod(F.xxhash64(*content) + F.col("_piece"), F.lit(SUBRANGES))
    placed = (
        distinct.withColumn("_cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)))
        .join(F.broadcast(cells), "_cell")  # CELLS rows
        .withColumn("_sub", mixed)
        .drop("_cell")
    )
    placed = stage(placed, "placed")
    sums = placed.groupBy("_node", "_sub").agg(F.sum("_n").alias("_n"))
    counts = {r["_node"]: r["n"] for r in sums.groupBy("_node").agg(F.sum("_n").alias("n")).collect()}
    total = sum(counts.values())
    segments = flow(ring, counts, quotas(total, shards))
    fields = "node int, first long, until long, shard int, slot long, home boolean"
    parts = _table(spark, segments, fields).select(
        F.col("node").alias("_node"), "first", "until", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")
    )
    before = F.sum("_n").over(W.partitionBy("_node").orderBy("_sub")) - F.col("_n")
    offsets = sums.select("_node", "_sub", before.alias("_before"))
    inside = F.sum("_n").over(W.partitionBy("_node", "_sub").orderBy(*content, "_piece"))
    ranked = placed.withColumn("_inside", inside - F.col("_n")).join(offsets, ["_node", "_sub"])
    start = F.col("_before") + F.col("_inside")
    rows = ranked.withColumn("_rank", F.explode(F.sequence(start, start + F.col("_n") - 1)))
    # A node has one segment and a few more where its home overflows: bounded by nodes and shards.
    here = (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("until"))
    return (
        rows.join(F.broadcast(parts), "_node")
        .filter(here)
        .select(
            *content,
            F.col("_home").alias("home_shard"),
            F.col("_shard").alias("shard"),
            (F.col("_slot") + F.col("_rank") - F.col("first")).alias("slot"),
        )
    )


def shard_report(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's columns; counts are the balance that holds, so no shard count follows a key."""
    return shard_rows(documents, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )

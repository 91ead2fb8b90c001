"""A bounded bitmap of hashed ids, to fetch or drop a few rows of a wide table with little shuffling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18  # of 64 bits: at most so many rows of two numbers are sent to every task


def sieved(rows: DataFrame, ids: DataFrame, name: str, *, missed: bool = False) -> DataFrame:
    """Rows whose ``name`` may occur in ``ids`` (one column of that name), or surely does not.

    The two calls part the rows. Every row of an id in ``ids`` is in the first part, together with a
    share of others that grows with the ids; where these are so many that the bitmap fills up, it
    passes everything and only the exact join that follows decides. Null ids occur nowhere.
    """
    place = F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(WORDS * 64))
    bits = (
        ids.filter(F.col(name).isNotNull())
        .select(F.shiftright(place, 6).alias("_word"), F.expr("1L").alias("_one"), (place % 64).cast("int").alias("_bit"))
        .groupBy("_word")
        .agg(F.expr("bit_or(shiftleft(_one, _bit))").alias("_bits"))
    )
    tested = rows.withColumn("_place", place).join(
        F.broadcast(bits), F.shiftright("_place", 6) == F.col("_word"), "left"
    )
    hit = F.coalesce(F.expr("getbit(_bits, cast(_place % 64 as int)) = 1"), F.lit(False)) & F.col(name).isNotNull()
    return tested.filter(~hit if missed else hit).select(*rows.columns)


def matching(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows whose ``name`` occurs in ``ids``; only rows that pass the sieve are shuffled."""
    return sieved(rows, ids, name).join(ids, name, "left_semi").select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows whose ``name`` does not occur in ``ids``; only rows in the sieve are shuffled."""
    rest = sieved(rows, ids, name).join(ids, name, "left_anti").select(*rows.columns)
    return sieved(rows, ids, name, missed=True).unionByName(rest)

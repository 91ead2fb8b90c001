"""Stored layouts that later jobs can use: bucketed tables for joins, day folders for pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "created"


def write_bucketed(df: DataFrame, table: str, by: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store ``df`` as the table ``table``, hashed by ``by`` into ``buckets`` sorted buckets.

    Rows are dealt to their buckets first, so that a bucket is one file. Two tables with equal
    buckets of a common key join without moving either (:func:`joined_buckets`). Choose buckets so
    that one of the larger table fits a task: about its size over 256 MB. ``path`` is a folder all
    executors share, by default the warehouse's.
    """
    writer = df.repartition(buckets, by).write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def buckets_of(spark: SparkSession, table: str) -> tuple[int, list[str]]:
    """(number of buckets, bucket columns) of a stored table; (0, []) if it has none."""
    rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    number = rows.get("Num Buckets")
    columns = [c.strip(" `") for c in rows.get("Bucket Columns", "[]").strip("[]").split(",")]
    return (int(number), columns) if number else (0, [])


def joined_buckets(spark: SparkSession, left: str, right: str, on: str) -> DataFrame:
    """Inner join of two bucketed tables by their bucket column: a merge of sorted buckets.

    Raises if the tables are not bucketed alike, since the join would then shuffle both.
    """
    layouts = [buckets_of(spark, t) for t in (left, right)]
    if layouts[0] != layouts[1] or layouts[0][1] != [on]:
        raise ValueError(f"{left} and {right} are not bucketed alike by {on}: {layouts}")
    return spark.table(left).hint("merge").join(spark.table(right), on)


def write_by_day(df: DataFrame, path: str, day: str = DAY, *, unit: str = "day", files: int = 1) -> str:
    """Store ``df`` in one folder a day (or ``unit``: week, month, year), ``files`` files each, so that
    a range of days reads no other folder. Take the unit whose rows fill at least one file of 128 MB.

    A folder's rows are spread over its files at random, so a hot day is not one task's. A NULL day
    has a folder of its own.
    """
    begin = F.col(day) if unit == "day" else F.trunc(day, unit)
    placed = df.withColumns({f"{day}_{unit}": begin.cast("date"), "_salt": F.floor(F.rand(1) * files)})
    dealt = placed.repartition(f"{day}_{unit}", "_salt").drop("_salt")
    dealt.write.mode("overwrite").partitionBy(f"{day}_{unit}").parquet(path)
    return path


def read_days(
    spark: SparkSession,
    path: str,
    since: str | None = None,
    until: str | None = None,
    day: str = DAY,
    *,
    unit: str = "day",
) -> DataFrame:
    """The days from ``since`` to ``until`` (both included) of :func:`write_by_day`; only the folders
    of their units are read, and within them the row groups that hold such days."""
    rows = spark.read.parquet(path)
    folder = F.col(f"{day}_{unit}").cast("date")
    for bound, last in ((since, False), (until, True)):
        if bound is None:
            continue
        asked = F.lit(bound).cast("date")
        begin = asked if unit == "day" else F.trunc(asked, unit)
        rows = rows.filter(folder <= begin if last else folder >= begin)
        rows = rows.filter(F.col(day) <= asked if last else F.col(day) >= asked)
    return rows.drop(f"{day}_{unit}")

"""Parameter grids as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_VALUES = 10_000  # candidates of one parameter


def grid_rows(axes: Mapping[str, DataFrame]) -> DataFrame:
    """All combinations of the distinct values of each axis (a table of one column), with ``run_id``.

    Runs are numbered from 0 in key order, the last key varying fastest, values in ascending order
    (NULL first). An axis of no value is an error, as are more than MOST_VALUES. Each axis becomes one
    array; the rows unfold from them in the executors, so nothing is joined.
    """
    if not axes:
        raise ValueError("a grid needs at least one parameter")
    rows = None
    for name, table in axes.items():
        column = table.columns[0]
        distinct = table.select(F.struct(F.col(column).alias("v")).alias("s")).distinct().limit(MOST_VALUES + 1)
        values = distinct.agg(F.sort_array(F.collect_list("s")).alias("a"))
        checked = F.when(
            F.size("a").between(1, MOST_VALUES), F.col("a")
        ).otherwise(F.raise_error(F.lit(f"{name} needs 1 to {MOST_VALUES} candidates")))
        values = values.select(checked.alias("a"))
        if rows is None:
            rows = values.select(F.size("a").alias("_n"), F.posexplode("a").alias("_at", "_v"))
            rows = rows.select(F.col("_at").cast("bigint").alias("run_id"), F.col("_v.v").alias(name))
        else:
            whole = rows.withColumn("_a", values.scalar())
            rows = whole.select(*rows.columns, F.size("_a").alias("_n"), F.posexplode("_a").alias("_at", "_v"))
            kept = [c for c in rows.columns if c not in ("run_id", "_n", "_at", "_v")]
            rows = rows.select(
                (F.col("run_id") * F.col("_n") + F.col("_at")).alias("run_id"), *kept, F.col("_v.v").alias(name)
            )
    return rows

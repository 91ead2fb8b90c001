"""Dataset profile with exact quartiles at any row count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.operators.features import numeric_columns
from dayloom.session import stage

QUARTILES = (0.25, 0.5, 0.75)
_SUMMARY = "column string, count bigint, nulls bigint, mean double, min double, max double"


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): every distinct value with its frequency, merged map-side."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return (
        df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    probabilities: Sequence[float] = QUARTILES,
    *,
    slices: int = 256,
) -> DataFrame:
    """One row per numeric column: count, nulls, mean, sample std, min, quantiles, max.

    The data is read once, into distinct values with their frequencies; those are stored and
    everything follows from them. The driver sees one row per column. Quantiles interpolate
    linearly and are exact without gathering a column: a sketch of the distinct values cuts
    each column into ``slices`` ranges, running totals over the ranges tell which of them hold
    the wanted ranks, and only these are ranked value by value. Any cut points would give the
    same result; the sketch only keeps the ranges even.
    """
    columns = list(columns or numeric_columns(df))
    counts = stage(value_counts(df, columns))
    n, value = F.col("n"), F.col("value")
    known = value.isNotNull()
    fractions = [i / slices for i in range(1, slices)]
    rows = (
        counts.groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(known, n)), F.lit(0)).alias("count"),
            F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("nulls"),
            F.sum(n * value).alias("total"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.percentile_approx("value", fractions, slices * 8).alias("cuts"),
        )
        .collect()
    )
    means = {r["column"]: r["total"] / r["count"] if r["count"] else None for r in rows}
    summary = df.sparkSession.createDataFrame(
        [(r["column"], r["count"], r["nulls"], means[r["column"]], r["min"], r["max"]) for r in rows],
        _SUMMARY,
    )
    centre = _per_column({c: F.lit(m).cast("double") for c, m in means.items()})
    spread = counts.groupBy("column").agg(
        F.sqrt(
            F.try_divide(F.sum(n * F.pow(value - centre, 2)), F.sum(F.when(known, n)) - 1)
        ).alias("std")
    )
    cuts = {r["column"]: sorted(set(r["cuts"] or [])) for r in rows}
    sizes = {r["column"]: r["count"] for r in rows}
    quantiles = _quantiles(counts.filter(known), cuts, sizes, probabilities, slices)
    names = [f"p{round(100 * p):d}" for p in probabilities]
    return (
        summary.join(spread, "column", "left")
        .join(quantiles, "column", "left")
        .select(
            "column",
            "count",
            "nulls",
            "mean",
            "std",
            "min",
            *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(names)],
            "max",
        )
    )


def _per_column(values: dict[str, Column]) -> Column:
    pairs = [x for c, v in values.items() for x in (F.lit(c), v)]
    return F.create_map(*pairs)[F.col("column")]


def _slice_of(value: Column, cuts: Column, slices: int) -> Column:
    """Number of sorted cut points at or below ``value`` (binary search by halving steps)."""
    steps = F.array(*[F.lit(2**k) for k in range(slices.bit_length(), -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at),
    )


def _quantiles(
    counts: DataFrame,
    cuts: dict[str, list[float]],
    sizes: dict[str, int],
    probabilities: Sequence[float],
    slices: int,
) -> DataFrame:
    """(column, q array) from value frequencies, linearly interpolated between ranks."""
    points = _per_column(
        {c: F.array(*[F.lit(v) for v in at]).cast("array<double>") for c, at in cuts.items()}
    )
    size = _per_column({c: F.lit(k) for c, k in sizes.items()})
    placed = counts.withColumn("slice", _slice_of(F.col("value"), points, slices))
    totals = placed.groupBy("column", "slice").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("column").orderBy("slice"))
    ranks = [F.lit(float(p)) * (size - 1) for p in probabilities]
    bounds = totals.select("column", "slice", upto.alias("upto"), (upto - F.col("n")).alias("before"))
    holds = F.lit(False)
    for r in ranks:
        holds = holds | ((F.floor(r) < F.col("upto")) & (F.ceil(r) >= F.col("before")))
    near = placed.join(bounds.filter(holds).drop("upto"), ["column", "slice"])
    inside = F.sum("n").over(W.partitionBy("column", "slice").orderBy("value"))
    ranked = near.withColumn("last", F.col("before") + inside - 1)
    picks = []
    for r in ranks:
        edges = []
        for at in (F.floor(r), F.ceil(r)):
            hit = (F.col("last") - F.col("n") < at) & (at <= F.col("last"))
            edges.append(F.max(F.when(hit, F.col("value"))))
        low, high = edges
        picks.append(low + (high - low) * F.max(r - F.floor(r)))
    return ranked.groupBy("column").agg(F.array(*picks).alias("q"))

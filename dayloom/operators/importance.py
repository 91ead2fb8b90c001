"""Feature importance of fitted window models, and shares within groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def raw_importances(model) -> np.ndarray:
    """Tree importances, or absolute coefficients of a linear model."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    raise ValueError("the model exposes neither importances nor coefficients")


def feature_importance(
    spark: SparkSession, model, features: Sequence[str], window: int = 28
) -> DataFrame:
    """(feature, importance, importance_pct), summed over the steps of the flat window."""
    values = raw_importances(model)
    if len(values) != len(features) * window:
        raise ValueError(f"{len(values)} importances for {len(features)} x {window} inputs")
    flat = spark.createDataFrame(
        [(i, float(v)) for i, v in enumerate(values)], "position int, importance double"
    )
    names = F.array(*[F.lit(f) for f in features])
    named = flat.select(
        F.get(names, F.col("position") % len(features)).alias("feature"), "importance"
    )
    summed = named.groupBy("feature").agg(F.sum("importance").alias("importance"))
    return share_within(summed, "importance")


def flat_feature_names(features: Sequence[str], window: int = 28) -> list[str]:
    """Names of the flat window inputs, oldest step first."""
    return [f"{f}@t-{back}" for back in range(window - 1, -1, -1) for f in features]


def share_within(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Adds ``{value}_pct``: the percentage of the group's total (a total of 0 counts as 1).

    Totals are aggregated map-side and joined back, so a large group is never gathered.
    """
    total = F.sum(value).alias("_total")
    if group:
        joined = df.join(df.groupBy(*group).agg(total), list(group))
    else:
        joined = df.withColumn("_total", df.agg(total).scalar())
    whole = F.when(F.col("_total") == 0, F.lit(1.0)).otherwise(F.col("_total"))
    share = F.lit(100.0) * F.col(value) / F.coalesce(whole, F.lit(1.0))
    return joined.withColumn(f"{value}_pct", share).drop("_total")


def top_n(df: DataFrame, value: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest rows by ``value``, ties by ``tie`` columns (a bounded top-N)."""
    return df.orderBy(F.col(value).desc(), *tie).limit(max(1, int(n)))


def top_n_per_group(
    df: DataFrame, value: str, n: int, group: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` largest rows of every group; Spark prunes per partition before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.col(value).desc(), *tie))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")

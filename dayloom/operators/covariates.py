"""Known covariates and the model-ready long frame of sequence models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.functions import clean_number, day_of, weekday_of
from dayloom.operators.calendar import (
    by_day,
    fill_both_ways,
    interpolate_linear,
    target_series,
)
from dayloom.operators.split import cut_index, interpolate_split

DAY = "created"


def known_covariates(panel: DataFrame, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """Spend summed and event flag maximised per day; missing values and columns are 0."""
    dated = panel.withColumn(day, day_of(day)).filter(F.col(day).isNotNull())
    steps = {"adSpend": F.sum, "event_start": F.max}
    aggregates = [
        F.coalesce(step(clean_number(c)), F.lit(0.0)).alias(c)
        if c in panel.columns
        else F.max(F.lit(0.0)).alias(c)
        for c, step in steps.items()
    ]
    return dated.groupBy(*keys, day).agg(*aggregates)


def attach_covariates(
    series: DataFrame, panel: DataFrame, keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """Covariates of every series day, 0 where the panel has none, plus tomorrow's event flag."""
    stale = [c for c in ("adSpend", "event_start", "event_start_next_1") if c in series.columns]
    joined = series.drop(*stale).join(known_covariates(panel, keys, day), [*keys, day], "left")
    filled = joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("adSpend", "event_start")}
    )
    ahead = F.lead("event_start").over(by_day(keys, day))
    return filled.withColumn("event_start_next_1", F.coalesce(ahead, F.lit(0.0)))


def model_frame(
    panel: DataFrame,
    target: str = "orders",
    keys: Sequence[str] = (),
    *,
    ratio: float | None = None,
    day: str = DAY,
) -> DataFrame:
    """Gap-free target with covariates, running index, series id and text calendar categories.

    With ``ratio`` the training and validation parts are filled separately.
    """
    series = target_series(panel, target, keys, day=day)
    if ratio is None:
        filled = interpolate_linear(series, "y", keys, day)
    else:
        filled = interpolate_split(series, ratio, keys, "y", day).drop("split")
    frame = fill_both_ways(attach_covariates(filled, panel, keys, day), "y", keys, day)
    series_id = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("main")
    return frame.withColumns(
        {
            "time_idx": (F.row_number().over(by_day(keys, day)) - 1).cast("bigint"),
            "series_id": series_id,
            "month": F.month(day).cast("string"),
            "weekday": weekday_of(day).cast("string"),
        }
    ).withColumnRenamed("y", target)


def ad_spend_scale(
    frame: DataFrame,
    keys: Sequence[str] = (),
    *,
    ratio: float | None = None,
    cutoff: int | None = None,
) -> DataFrame:
    """Mean and sample std of log1p spend over the training rows (std 0 or NULL: 1).

    With ``ratio`` those are the first rows of each series by ``time_idx``, cut as the time split
    cuts them; with ``cutoff`` the rows up to that index of every series.
    """
    if (ratio is None) == (cutoff is None):
        raise ValueError("give either ratio or cutoff")
    if ratio is not None:
        rows = F.count(F.lit(1)).over(W.partitionBy(*keys))
        frame = frame.withColumn("_train", F.col("time_idx") < cut_index(rows, ratio))
    else:
        frame = frame.withColumn("_train", F.col("time_idx") <= cutoff)
    logged = F.log1p(F.coalesce(clean_number("adSpend"), F.lit(0.0)))
    std = F.stddev_samp(logged)
    return (
        frame.filter("_train")
        .groupBy(*keys)
        .agg(
            F.avg(logged).alias("log_mean"),
            F.coalesce(F.when(std > 0, std), F.lit(1.0)).alias("log_std"),
        )
    )


def scale_ad_spend(frame: DataFrame, scale: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``adSpend`` as standardised log1p, with the training statistics."""
    logged = F.log1p(F.coalesce(clean_number("adSpend"), F.lit(0.0)))
    if keys:
        joined = frame.join(scale, list(keys))
    else:
        stats = scale.select(F.struct("log_mean", "log_std")).scalar()
        joined = frame.withColumns({"log_mean": stats["log_mean"], "log_std": stats["log_std"]})
    return joined.withColumn(
        "adSpend", (logged - F.col("log_mean")) / F.col("log_std")
    ).drop("log_mean", "log_std")


def unscale_ad_spend(value, scale):
    """Inverse of :func:`scale_ad_spend` for a column and a scale struct column."""
    return F.expm1(value * scale["log_std"] + scale["log_mean"])

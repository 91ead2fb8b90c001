"""Time-ordered train / validation split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.functions import days_since
from dayloom.operators.calendar import by_day, interpolate_linear

DAY = "created"


def check_ratio(ratio: float) -> float:
    if not 0.0 < ratio < 1.0:
        raise ValueError("the validation share lies strictly between 0 and 1")
    return ratio


def cut_index(rows: Column, ratio: float) -> Column:
    """Number of training rows, ``int(n * (1 - ratio))`` in binary double arithmetic."""
    return (rows.cast("double") * F.lit(1.0 - check_ratio(ratio))).cast("int")


def time_split(
    df: DataFrame, ratio: float, keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """Adds ``split`` ('train' or 'val'): the last rows of every series validate."""
    position = F.row_number().over(by_day(keys, day)) - 1
    rows = F.count(F.lit(1)).over(W.partitionBy(*keys))
    split = F.when(position < cut_index(rows, ratio), F.lit("train")).otherwise(F.lit("val"))
    return df.withColumn("split", split)


def validation_start(day: str, ratio: float, keys: Sequence[str] = ()) -> Column:
    """First validation day of a series' full calendar, from its observed rows alone.

    Equals splitting the calendar-completed series, without inserting a single row.
    """
    whole = W.partitionBy(*keys)
    first, last = F.min(day).over(whole), F.max(day).over(whole)
    return F.date_add(first, cut_index(days_since(last, first) + 1, ratio))


def interpolate_split(
    series: DataFrame, ratio: float, keys: Sequence[str] = (), value: str = "y", day: str = DAY
) -> DataFrame:
    """Split first, then fill gaps inside each part, so validation never informs training."""
    return interpolate_linear(time_split(series, ratio, keys, day), value, [*keys, "split"], day)


def flat_split(
    windows: DataFrame, ratio: float, keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """(keys, day, split, features, y): windows flattened to ML vectors with their part."""
    parts = time_split(windows.select(*keys, day, "X", "y"), ratio, keys, day)
    return parts.select(
        *keys,
        day,
        "split",
        array_to_vector(F.flatten("X")).alias("features", metadata=windows.schema["X"].metadata),
        "y",
    )

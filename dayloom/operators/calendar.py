"""Gap-free calendars, duplicate days, open last days and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.functions import clean_number, day_of, days_since

DAY = "created"


def by_day(keys: Sequence[str] = (), day: str = DAY):
    """Window over one series in day order. A series holds at most one row per calendar day.

    All ordered windows use this one ordering, so consecutive ones share a single sort.
    """
    return W.partitionBy(*keys).orderBy(F.col(day).asc_nulls_last())


def dedup_keep_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], day: str = DAY
) -> DataFrame:
    """One row per (keys, day): the one greatest by ``order``. Combines map-side."""
    group = [*keys, day]
    rest = [c for c in df.columns if c not in group]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.filter(F.col(day).isNotNull()).groupBy(*group).agg(last).select(*group, "_last.*")


def complete_calendar(df: DataFrame, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """Insert the missing days between each series' first and last day, all other columns NULL.

    Every row unfolds into itself plus the gap up to its successor. That needs one shuffle by
    series key, which the ordered windows that follow reuse, and no join with a calendar.
    """
    successor = F.lead(day).over(by_day(keys, day))
    rest = [c for c in df.columns if c not in (*keys, day)]
    until = F.coalesce(F.date_sub("_next", 1), F.col(day))
    spread = (
        df.filter(F.col(day).isNotNull())
        .withColumn("_next", successor)
        .select(
            *keys,
            F.col(day).alias("_own"),
            F.explode(F.sequence(F.col(day), until)).alias(day),
            *rest,
        )
    )
    own = F.col(day) == F.col("_own")
    # Unfolding keeps the order, but Spark cannot know; one sort here serves all later windows.
    return spread.select(
        *keys, day, *[F.when(own, F.col(c)).alias(c) for c in rest]
    ).sortWithinPartitions(*keys, F.col(day).asc_nulls_last())


def trim_last_day(df: DataFrame, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """Drop each series' last row, the still open day. Rows without a day sort last."""
    follows = F.lead(F.lit(True)).over(by_day(keys, day))
    return df.withColumn("_follows", follows).filter("_follows").drop("_follows")


def drop_open_day(df: DataFrame, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """:func:`trim_last_day` that fails on a non-empty series of fewer than two days."""
    alone = F.count(F.lit(1)).over(W.partitionBy(*keys)) < 2
    checked = F.when(
        alone, F.raise_error(F.lit("a series needs at least two days to drop the open one"))
    ).otherwise(F.lead(F.lit(True)).over(by_day(keys, day)))
    return df.withColumn("_follows", checked.cast("boolean")).filter("_follows").drop("_follows")


def target_series(
    df: DataFrame,
    target: str,
    keys: Sequence[str] = (),
    *,
    complete: bool = True,
    day: str = DAY,
) -> DataFrame:
    """(keys, day, y): values summed per day; with ``complete``, missing days have NULL ``y``."""
    rows = df.select(*keys, day_of(day).alias(day), clean_number(target).alias("y")).dropna(
        subset=[day, "y"]
    )
    series = rows.groupBy(*keys, day).agg(F.sum("y").alias("y"))
    return complete_calendar(series, keys, day) if complete else series


def _fill_windows(keys: Sequence[str], day: str):
    """Running windows up to each row, seen from the start and from the end of the series.

    The second one sorts descending: a frame that reaches from a row to the end would be
    evaluated anew for every row.
    """
    back = W.partitionBy(*keys).orderBy(F.col(day).desc())
    return tuple(w.rowsBetween(W.unboundedPreceding, 0) for w in (by_day(keys, day), back))


def interpolate_linear(
    df: DataFrame, value: str = "y", keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """Fill NULLs of ``value`` linearly over time; the ends repeat the nearest known value."""
    ahead, back = _fill_windows(keys, day)
    known_day = F.when(F.col(value).isNotNull(), F.col(day))
    out = df
    for side, w in (("_l", ahead), ("_r", back)):
        out = out.withColumns(
            {
                f"{side}d": F.last(known_day, ignorenulls=True).over(w),
                f"{side}v": F.last(value, ignorenulls=True).over(w),
            }
        )
    left, right = F.col("_lv"), F.col("_rv")
    share = days_since(day, "_ld") / days_since("_rd", "_ld")
    filled = F.coalesce(F.col(value), left + (right - left) * share, left, right)
    return out.withColumn(value, filled).drop("_ld", "_lv", "_rd", "_rv")


def fill_both_ways(
    df: DataFrame, value: str, keys: Sequence[str] = (), day: str = DAY, default: float = 0.0
) -> DataFrame:
    """Forward fill, then backward fill, then ``default``."""
    earlier, later = (F.last(value, ignorenulls=True).over(w) for w in _fill_windows(keys, day))
    return df.withColumn(value, F.coalesce(earlier, later, F.lit(default)))

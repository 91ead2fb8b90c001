"""Panel features: imputation, cyclical encodings, lags, growth, leads, percentage changes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions import cyclical, daily_ratio, finite, weekday_of
from dayloom.operators.calendar import by_day, complete_calendar

DAY = "created"


def parse_lags(lags: Iterable[int]) -> list[int]:
    """Sorted distinct positive lags."""
    return sorted({int(k) for k in lags if int(k) > 0})


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order (a schema lookup, no data is read)."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in without
    ]


def impute(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    *,
    strategy: str = "median",
    indicators: bool = False,
    fit_until: str | None = None,
    day: str = DAY,
) -> DataFrame:
    """Replace NULLs by the column's mean or exact median within the series, 0 if all NULL.

    The statistic covers the whole series unless ``fit_until`` ends it early. It is computed as
    a window over the series, so it reuses the partitioning of the surrounding panel windows.
    """
    if strategy not in ("mean", "median"):
        raise ValueError("strategy must be 'mean' or 'median'")
    whole = W.partitionBy(*keys)
    updates = {}
    for c in columns:
        seen = F.col(c).cast("double")
        if fit_until is not None:
            seen = F.when(F.col(day) <= F.lit(fit_until).cast("date"), seen)
        stat = F.avg(seen) if strategy == "mean" else F.percentile(seen, F.lit(0.5))
        if indicators:
            updates[f"{c}_was_missing"] = F.col(c).isNull().cast("int")
        updates[c] = F.coalesce(F.col(c).cast("double"), stat.over(whole), F.lit(0.0))
    return df.withColumns(updates)


def add_cyclical(df: DataFrame, day: str = DAY) -> DataFrame:
    """Sine and cosine of weekday (0..6 of 7) and month (1..12 of 12), from the date itself."""
    weekday_sin, weekday_cos = cyclical(weekday_of(day), 7)
    month_sin, month_cos = cyclical(F.month(day), 12)
    return df.withColumns(
        {
            "created_weekday_sin": weekday_sin,
            "created_weekday_cos": weekday_cos,
            "created_month_sin": month_sin,
            "created_month_cos": month_cos,
        }
    )


def add_lags(
    df: DataFrame,
    lags: Iterable[int],
    keys: Sequence[str] = (),
    *,
    columns: Sequence[str] = ("adSpend", "orders"),
    day: str = DAY,
) -> DataFrame:
    """``{column}_lag_{k}`` = the value k rows earlier in the series."""
    w = by_day(keys, day)
    present = [c for c in columns if c in df.columns]
    return df.withColumns(
        {f"{c}_lag_{k}": F.lag(c, k).over(w) for k in parse_lags(lags) for c in present}
    )


def add_growth(df: DataFrame, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """Day-over-day growth of revenue and spend; NULL where the day before was 0 or missing."""
    w = by_day(keys, day)
    pairs = {"revenue_growth": "totalRevenue", "investment_growth": "adSpend"}
    return df.withColumns(
        {name: daily_ratio(c, F.lag(c).over(w)) for name, c in pairs.items() if c in df.columns}
    )


def add_event_lead(df: DataFrame, keys: Sequence[str] = (), day: str = DAY) -> DataFrame:
    """Event flag as a whole number, and tomorrow's flag (0 on the last day)."""
    if "event_start" not in df.columns:
        return df
    flag = F.floor(F.coalesce(F.col("event_start").cast("double"), F.lit(0.0))).cast("double")
    marked = df.withColumn("event_start", flag)
    ahead = F.lead("event_start").over(by_day(keys, day))
    return marked.withColumn("event_start_next_1", F.coalesce(ahead, F.lit(0.0)))


def feature_panel(
    combined: DataFrame,
    keys: Sequence[str] = (),
    *,
    lags: Iterable[int] = (1, 7, 30),
    target: str = "orders",
    strategy: str = "median",
    fit_until: str | None = None,
    day: str = DAY,
) -> DataFrame:
    """The model panel: gap-free days, imputed numbers, cyclical, lag, growth and lead features.

    Numbers are imputed twice: before the lags (inserted days get a target too) and after them
    (first-row lags and undefined growth, target left alone). All steps are windows over the
    same series, so the whole panel costs one shuffle by series key.
    """
    numbers = numeric_columns(combined, without=keys)
    doubles = combined.withColumns({c: finite(F.col(c).cast("double")) for c in numbers})
    options = {"strategy": strategy, "fit_until": fit_until, "day": day}
    panel = add_cyclical(complete_calendar(doubles, keys, day), day)
    panel = impute(panel, numbers, keys, **options)
    panel = add_lags(panel, lags, keys, day=day)
    panel = add_growth(panel, keys, day)
    panel = add_event_lead(panel, keys, day)
    derived = [
        c
        for c in panel.columns
        if "_lag_" in c or c in ("revenue_growth", "investment_growth")
    ]
    return impute(panel, [c for c in derived if c != target], keys, **options)


def pct_change(
    df: DataFrame, value: str, keys: Sequence[str] = (), day: str = DAY
) -> DataFrame:
    """``{value}_pct_change`` against the previous observed row, in percent; undefined rows drop."""
    name = f"{value}_pct_change"
    before = F.lag(value).over(by_day(keys, day))
    return df.withColumn(name, F.lit(100.0) * daily_ratio(value, before)).dropna(subset=[name])


def pct_change_smoothed(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    *,
    window: int = 7,
    center: bool = True,
    day: str = DAY,
) -> DataFrame:
    """Adds the moving mean of :func:`pct_change` over ``window`` remaining rows (at least 1)."""
    window = max(1, int(window))
    name = f"{value}_pct_change"
    ahead = (window - 1) // 2 if center else 0
    frame = by_day(keys, day).rowsBetween(ahead - window + 1, ahead)
    return pct_change(df, value, keys, day).withColumn(
        f"{name}_ma{window}", F.avg(name).over(frame)
    )

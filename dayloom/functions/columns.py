"""Scalar column expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: ColumnLike) -> Column:
    """NULL for NaN and +-inf (Spark orders NaN above +inf, so one test covers all three)."""
    c = as_column(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def clean_number(c: ColumnLike) -> Column:
    """Text or number to DOUBLE; anything that is no finite number becomes NULL."""
    return finite(as_column(c).try_cast("double"))


def whole_number(c: ColumnLike) -> Column:
    """:func:`clean_number`, NULL to 0, truncated to BIGINT."""
    return F.coalesce(clean_number(c), F.lit(0.0)).cast("bigint")


def day_of(c: ColumnLike) -> Column:
    """Calendar day of a date, timestamp or ISO text; NULL if unreadable."""
    return as_column(c).try_cast("date")


def day_number(c: ColumnLike) -> Column:
    """Days since 1970-01-01: the ordering used by range frames."""
    return F.unix_date(as_column(c))


def weekday_of(c: ColumnLike) -> Column:
    """0 = Monday."""
    return F.weekday(as_column(c))


def days_since(end: ColumnLike, start: ColumnLike) -> Column:
    return F.datediff(as_column(end), as_column(start))


def cyclical(c: ColumnLike, period: int) -> tuple[Column, Column]:
    """(sin, cos) position of ``c`` on a circle of ``period`` steps."""
    angle = F.lit(2.0 * math.pi) * as_column(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def daily_ratio(now: ColumnLike, before: ColumnLike) -> Column:
    """Relative change ``now / before - 1``; NULL instead of NaN or inf."""
    now, before = as_column(now), as_column(before)
    return F.try_divide((now - before).cast("double"), before.cast("double"))


def threshold_flag(c: ColumnLike, cut: float = 0.5) -> Column:
    return (as_column(c) >= F.lit(cut)).cast("double")


def same_text(c: ColumnLike, wanted: str) -> Column:
    return F.lower(as_column(c).cast("string")) == F.lower(F.lit(wanted))


def label_title(c: ColumnLike) -> Column:
    """``ridge_small`` to ``Ridge Small``."""
    return F.initcap(F.replace(as_column(c), F.lit("_"), F.lit(" ")))


def bucket_of(value: ColumnLike, low: ColumnLike, high: ColumnLike, bins: int) -> Column:
    """0-based equal-width bin; the last bin also owns its right edge, outside is NULL."""
    value, low, high = as_column(value), as_column(low), as_column(high)
    place = F.floor((value - low) * F.lit(float(bins)) / (high - low)).cast("int")
    return F.when(
        (value >= low) & (value <= high), F.least(place, F.lit(bins - 1))
    )

"""Trailing-mean / same-weekday-median forecaster: backtest, forecast, grid, revenue heuristic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.functions import day_number, weekday_of
from dayloom.operators.calendar import by_day, complete_calendar, interpolate_linear
from dayloom.operators.evaluate import metric_columns
from dayloom.operators.split import check_ratio, time_split, validation_start
from dayloom.sources.tables import history_before

DAY = "created"
# Names of the revenue estimates.
METHODS = ("blend", "trailing_mean_7", "same_weekday_median")


@dataclass(frozen=True)
class Blend:
    """Parameters of the forecaster. The component columns keep their names for any lengths.

    Fixed values: the defaults.
    """

    trailing_days: int = 7
    weekday_weeks: int = 8
    trailing_weight: float = 0.45
    weekday_weight: float = 0.55

    def mix(self, trailing: Column, weekday: Column) -> Column:
        """Weighted sum; a missing component leaves the other one, both missing gives NULL."""
        both = F.lit(self.trailing_weight) * trailing + F.lit(self.weekday_weight) * weekday
        return F.coalesce(both, trailing, weekday)


def _trailing_mean(value: str, days: int, keys: Sequence[str]) -> Column:
    w = W.partitionBy(*keys).orderBy("_n").rangeBetween(-days, -1)
    return F.avg(value).over(w)


def _weekday_median(value: str, weeks: int, keys: Sequence[str]) -> Column:
    w = W.partitionBy(*keys, "_weekday").orderBy("_n").rangeBetween(-7 * weeks, -1)
    return F.percentile(value, F.lit(0.5)).over(w)


def with_components(
    series: DataFrame, keys: Sequence[str] = (), spec: Blend = Blend(), day: str = DAY
) -> DataFrame:
    """Adds both components of every row, from actual history before that day.

    The frames run over day numbers, so missing days need no rows. Both windows share one
    shuffle by series key; the weekday window only sorts again inside it.
    """
    placed = series.withColumns({"_n": day_number(day), "_weekday": weekday_of(day)})
    return (
        placed.withColumn("trailing_mean_7", _trailing_mean("y", spec.trailing_days, keys))
        .withColumn("same_weekday_median_8w", _weekday_median("y", spec.weekday_weeks, keys))
        .drop("_n", "_weekday")
    )


def baseline_backtest(
    series: DataFrame,
    keys: Sequence[str] = (),
    *,
    ratio: float = 0.2,
    spec: Blend = Blend(),
    day: str = DAY,
    strict: bool = False,
) -> DataFrame:
    """One-step-ahead predictions of the validation days that have an actual value.

    ``series`` may be sparse: the split position comes from the covered calendar span. A day
    without any history has a NULL prediction, or fails the query with ``strict``.
    """
    check_ratio(ratio)
    marked = with_components(series.filter(F.col("y").isNotNull()), keys, spec, day).withColumn(
        "_start", validation_start(day, ratio, keys)
    )
    held_out = marked.filter(F.col(day) >= F.col("_start"))
    index = F.row_number().over(by_day(keys, day)) - 1
    prediction = spec.mix(F.col("trailing_mean_7"), F.col("same_weekday_median_8w"))
    if strict:
        prediction = _insist(prediction)
    return held_out.select(
        *keys,
        index.cast("bigint").alias("sample_idx"),
        day,
        F.col("y").alias("y_true"),
        "trailing_mean_7",
        "same_weekday_median_8w",
        prediction.alias("y_pred"),
    )


def _insist(prediction: Column) -> Column:
    problem = F.raise_error(F.lit("not enough history to predict")).cast("double")
    return F.coalesce(prediction, problem)


def check_horizon(days: int) -> int:
    if not 1 <= days <= 365:
        raise ValueError("a forecast covers 1 to 365 days")
    return days


def baseline_forecast(
    series: DataFrame,
    days: int,
    keys: Sequence[str] = (),
    *,
    first: str | None = None,
    spec: Blend = Blend(),
    day: str = DAY,
    strict: bool = True,
) -> DataFrame:
    """Forecast ``days`` days from ``first`` (default: the day after each series' last day).

    Every future day looks back from the end of the series, so a series is reduced to one
    trailing mean and seven weekday medians before its days are unfolded. With ``strict`` an
    earlier ``first`` or a day without any history fails the query.
    """
    check_horizon(days)
    known = series.filter(F.col("y").isNotNull())
    anchor = F.date_add(F.max(day).over(W.partitionBy(*keys)), 1)
    reach = max(spec.trailing_days, 7 * spec.weekday_weeks)
    recent = known.withColumn("_anchor", anchor).filter(
        F.col(day) >= F.date_sub("_anchor", reach)
    )
    age = F.datediff(F.col("_anchor"), F.col(day))
    medians = [
        F.percentile(
            F.when((weekday_of(day) == i) & (age <= 7 * spec.weekday_weeks), F.col("y")),
            F.lit(0.5),
        )
        for i in range(7)
    ]
    summary = recent.groupBy(*keys).agg(
        F.max("_anchor").alias("_anchor"),
        F.avg(F.when(age <= spec.trailing_days, F.col("y"))).alias("trailing_mean_7"),
        F.array(*medians).alias("_medians"),
    )
    begin = F.col("_anchor")
    if first is not None:
        begin = F.lit(first).cast("date")
        if strict:
            begin = F.when(begin >= F.col("_anchor"), begin).otherwise(
                F.raise_error(F.lit("the first day lies inside the observed series"))
            )
    unfolded = summary.select(
        *keys,
        F.explode(F.sequence(begin, F.date_add(begin, days - 1))).alias(day),
        F.date_sub("_anchor", 1).alias("series_last_date"),
        "trailing_mean_7",
        "_medians",
    )
    picked = unfolded.withColumn(
        "same_weekday_median_8w", F.get("_medians", weekday_of(day))
    ).drop("_medians")
    prediction = spec.mix(F.col("trailing_mean_7"), F.col("same_weekday_median_8w"))
    if strict:
        prediction = _insist(prediction)
    return picked.withColumn("prediction", prediction)


def heuristic_revenue(
    table: DataFrame,
    first: str,
    days: int = 14,
    *,
    method: str = "blend",
    limit: int = 500,
    day: str = "date",
    value: str = "totalRevenue",
    spec: Blend = Blend(),
) -> DataFrame:
    """Revenue estimates for a window of days that may lie inside or beyond the history.

    At most ``limit`` observations before the end of the window count, so everything after the
    top-N works on that many rows. A day without history has a NULL estimate.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    spark = table.sparkSession
    begin = F.lit(first).cast("date")
    frame = spark.range(1).select(
        F.explode(F.sequence(begin, F.date_add(begin, days - 1))).alias(DAY)
    )
    end = (date.fromisoformat(first) + timedelta(days=days)).isoformat()
    past = history_before(table, end, day=day, value=value, limit=limit).select(
        F.col(day).alias(DAY), F.col(value).alias("y")
    )
    last = past.agg(F.max(DAY)).scalar()
    asked = frame.withColumn(
        "_anchor", F.when(F.col(DAY) > last, F.date_add(last, 1)).otherwise(F.col(DAY))
    )
    reach = max(spec.trailing_days, 7 * spec.weekday_weeks)
    lookback = asked.select(
        F.col(DAY).alias("date"),
        "_anchor",
        F.explode(
            F.sequence(F.date_sub("_anchor", reach), F.date_sub("_anchor", 1))
        ).alias(DAY),
    )
    age = F.datediff(F.col("_anchor"), F.col(DAY))
    same = weekday_of(DAY) == weekday_of("date")
    components = (
        lookback.join(past, DAY, "left")
        .groupBy("date")
        .agg(
            F.avg(F.when(age <= spec.trailing_days, F.col("y"))).alias("trailing_mean_7"),
            F.percentile(
                F.when(same & (age <= 7 * spec.weekday_weeks), F.col("y")), F.lit(0.5)
            ).alias("same_weekday_median_8w"),
        )
    )
    trailing, weekday = F.col("trailing_mean_7"), F.col("same_weekday_median_8w")
    estimate = {
        "blend": spec.mix(trailing, weekday),
        "trailing_mean_7": trailing,
        "same_weekday_median": weekday,
    }[method]
    return components.withColumn("estimate", estimate)


def heuristic_total(estimates: DataFrame) -> DataFrame:
    """Sum of the estimated days, and whether every day has an estimate."""
    return estimates.agg(
        F.round(F.coalesce(F.sum("estimate"), F.lit(0.0)), 2).alias("predicted_total_sum"),
        F.every(F.col("estimate").isNotNull()).alias("all_days_estimated"),
        F.count(F.lit(1)).alias("days"),
    )


def baseline_grid(
    series: DataFrame,
    grid: Sequence[dict],
    keys: Sequence[str] = (),
    *,
    ratio: float = 0.2,
    day: str = DAY,
    pooled: bool = False,
) -> DataFrame:
    """Validation metrics of every candidate in ``grid``, all in one job.

    Each distinct trailing length and weekday depth is one window column, shared by all
    candidates using it. Missing validation days are interpolated first; history is not.
    Metrics are per series, or over all of them with ``pooled``.
    """
    specs = [grid_spec(entry) for entry in grid]
    dense = time_split(complete_calendar(series, keys, day), ratio, keys, day)
    filled = interpolate_linear(
        dense.withColumn("y_true", F.col("y")), "y_true", [*keys, "split"], day
    )
    placed = filled.withColumns({"_n": day_number(day), "_weekday": weekday_of(day)})
    placed = placed.withColumns(
        {f"_t{d}": _trailing_mean("y", d, keys) for d in sorted({s.trailing_days for s in specs})}
    )
    placed = placed.withColumns(
        {f"_w{k}": _weekday_median("y", k, keys) for k in sorted({s.weekday_weeks for s in specs})}
    )
    runs = F.array(
        *[
            F.struct(
                F.lit(i).alias("run_id"),
                s.mix(F.col(f"_t{s.trailing_days}"), F.col(f"_w{s.weekday_weeks}")).alias("y_pred"),
            )
            for i, s in enumerate(specs)
        ]
    )
    rows = placed.filter("split = 'val'").select(*keys, "y_true", F.explode(runs).alias("run"))
    groups = [] if pooled else list(keys)
    scored = rows.select(*groups, "y_true", "run.*").groupBy(*groups, "run_id").agg(*metric_columns())
    described = F.create_map(
        *[
            x
            for i, s in enumerate(specs)
            for x in (
                F.lit(i),
                F.struct(
                    F.lit(s.trailing_days).alias("trailing_days"),
                    F.lit(s.weekday_weeks).alias("weekday_weeks"),
                    F.lit(s.trailing_weight).alias("trailing_weight"),
                    F.lit(s.weekday_weight).alias("weekday_weight"),
                ),
            )
        ]
    )
    return scored.withColumn("_p", described[F.col("run_id")]).select(
        *groups, "run_id", "_p.*", "mae", "rmse", "mape"
    )


def grid_spec(entry: dict) -> Blend:
    """Candidate parameters under their configuration names."""
    return Blend(
        trailing_days=int(entry.get("baseline_trailing_days", 7)),
        weekday_weeks=int(entry.get("baseline_weekday_weeks", 8)),
        trailing_weight=float(entry.get("baseline_trailing_weight", 0.45)),
        weekday_weight=float(entry.get("baseline_weekday_weight", 0.55)),
    )

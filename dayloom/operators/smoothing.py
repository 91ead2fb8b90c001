"""Additive-trend, additive-weekly-season exponential smoothing of many series at once."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.operators.baseline import check_horizon
from dayloom.operators.calendar import interpolate_linear
from dayloom.operators.split import interpolate_split

DAY = "created"
SEASON = 7
GRID = tuple(product((0.05, 0.2, 0.5), (0.01, 0.1), (0.05, 0.2)))
ROUNDS = 12  # of refinement at most; each costs 8 runs over the days
STEP = 0.1  # first step of a refinement
TOLERANCE = 0.01  # step below which a series is done
LEAST = 0.0001  # distance that parameters keep from 0 and 1


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def _point(a, b, g, shift) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), g.alias("g"), shift.alias("shift"))


def _named(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once: a transform of one element gives it a name."""
    return F.transform(F.array(value), then)[0]


def _fold(grid: Sequence[tuple[float, float, float]], rounds: int, tolerance: float) -> Column:
    """The smoothing of least squared one-step error: (sse, a, b, g, shift, level, trend, season).

    Parameters are folded over the days of ``_y`` with level, trend and the week's season as state.
    Before the first day that is a line through the first two weeks and the first week's distance
    from it, raised by ``shift``; the season takes part from two full weeks on. Every grid point is
    tried; from the best one on, up to ``rounds`` times, each of the four numbers goes up and down by
    a step. The best of these moves is taken while it lowers the error, else the step is halved; a
    series is done when its step is below ``tolerance``. So the error is never above the grid's.
    """
    y, seasonal = F.col("_y"), F.size("_y") >= 2 * SEASON
    first, second = _mean(F.slice(y, 1, SEASON)), _mean(F.slice(y, SEASON + 1, SEASON))
    head = F.get(y, F.lit(0))
    step = F.when(F.size(y) > 1, F.get(y, F.lit(1)) - head).otherwise(F.lit(0.0))
    slope = F.when(seasonal, (second - first) / SEASON).otherwise(step)
    start = F.when(seasonal, first - slope * (SEASON + 1) / 2).otherwise(head - slope)
    offsets = F.when(
        seasonal,
        F.transform(F.slice(y, 1, SEASON), lambda v, i: v - (start + slope * (i + 1))),
    ).otherwise(F.array_repeat(F.lit(0.0), SEASON))
    days = F.transform(y, lambda v, i: F.struct(v.alias("y"), (i % SEASON).alias("at")))
    points = F.array(*[_point(*[F.lit(float(v)) for v in (*p, 0.0)]) for p in grid])

    def advance(state: Column, day: Column, point: Column) -> Column:
        gamma = F.when(seasonal, point["g"]).otherwise(F.lit(0.0))
        expected = state["level"] + state["trend"]
        s = F.get(state["season"], day["at"])
        raised = point["a"] * (day["y"] - s) + (1 - point["a"]) * expected
        error = day["y"] - expected - s
        return F.struct(
            raised.alias("level"),
            (point["b"] * (raised - state["level"]) + (1 - point["b"]) * state["trend"]).alias("trend"),
            F.transform(
                state["season"],
                lambda v, i: F.when(
                    i == day["at"], gamma * (day["y"] - expected) + (1 - gamma) * s
                ).otherwise(v),
            ).alias("season"),
            (state["sse"] + error * error).alias("sse"),
        )

    def run(point: Column, place: Column) -> Column:
        zero = F.struct(
            (start + point["shift"]).alias("level"),
            slope.alias("trend"),
            offsets.alias("season"),
            F.lit(0.0).alias("sse"),
        )
        end = F.aggregate(days, zero, lambda state, day: advance(state, day, point))
        kept = [point[c].alias(c) for c in ("a", "b", "g", "shift")]
        return _named(
            end,
            lambda e: F.struct(e["sse"].alias("sse"), place.alias("place"), *kept, *[e[c].alias(c) for c in ("level", "trend", "season")]),
        )

    def best_of(tried: Column) -> Column:
        return F.array_min(F.transform(tried, run))

    def moves(state: Column) -> Column:
        """One number moved by the step, within its range; the level by the size of an error."""
        unit = F.sqrt(state["best"]["sse"] / F.size(y))
        now = {c: state["best"][c] for c in ("a", "b", "g", "shift")}
        out = []
        for c in now:
            for sign in (1.0, -1.0):
                by = state["step"] * sign * (unit if c == "shift" else F.lit(1.0))
                moved = now[c] + by
                if c != "shift":
                    moved = F.least(F.greatest(moved, F.lit(LEAST)), F.lit(1 - LEAST))
                out.append(_point(*[moved if k == c else v for k, v in now.items()]))
        return F.array(*out)

    def improve(state: Column, _: Column) -> Column:
        def decide(found: Column) -> Column:
            lower = found["sse"] < state["best"]["sse"]
            return F.struct(
                F.when(lower, found).otherwise(state["best"]).alias("best"),
                F.when(lower, state["step"]).otherwise(state["step"] / 2).alias("step"),
            )

        return F.when(state["step"] < tolerance, state).otherwise(_named(best_of(moves(state)), decide))

    if not rounds:
        return best_of(points)
    begin = F.struct(best_of(points).alias("best"), F.lit(STEP).alias("step"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, improve, lambda state: state["best"])


def _run(df: DataFrame, keys: Sequence[str], horizon: str, grid, rounds: int, tolerance: float) -> DataFrame:
    """(keys, created, prediction, alpha, beta, gamma, sse): every series from its training days.

    A series is one row holding at most one value per calendar day; all of it stays on the JVM.
    """
    train = F.when(F.col("_train"), F.struct(DAY, F.col("y").cast("double").alias("y")))
    series = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(train)).alias("_d"), F.max(horizon).alias("_h")
    )
    series = series.filter((F.size("_d") > 0) & (F.col("_h") >= 1)).select(
        *keys,
        F.transform("_d", lambda d: d["y"]).alias("_y"),
        F.element_at("_d", -1)[DAY].alias("_last"),
        "_h",
    )
    fitted = series.withColumn("_b", _fold(grid, rounds, tolerance))
    ahead = fitted.select(
        *keys, "_y", "_last", "_b", F.explode(F.sequence(F.lit(1), F.col("_h").cast("int"))).alias("_k")
    )
    chosen = [F.col(f"_b.{c}").alias(n) for c, n in (("a", "alpha"), ("b", "beta"), ("g", "gamma"))]
    season = F.get(F.col("_b.season"), (F.size("_y") + F.col("_k") - 1) % SEASON)
    return ahead.select(
        *keys,
        F.date_add("_last", F.col("_k")).alias(DAY),
        (F.col("_b.level") + F.col("_k") * F.col("_b.trend") + season).alias("prediction"),
        *chosen,
        F.col("_b.sse").alias("sse"),
    )


def smoothing_forecast(
    series: DataFrame,
    days: int,
    keys: Sequence[str] = (),
    *,
    first: str | None = None,
    grid=GRID,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Forecast ``days`` days from ``first`` (default: the day after each gap-free series).

    Parameters start from the best point of ``grid`` and are refined; ``rounds=0`` keeps the point.
    """
    check_horizon(days)
    filled = interpolate_linear(series, "y", keys)
    gap = F.lit(0)
    if first is not None:
        ahead = F.datediff(F.lit(first).cast("date"), F.max(DAY).over(W.partitionBy(*keys))) - 1
        gap = F.when(ahead >= 0, ahead).otherwise(
            F.raise_error(F.lit("the first day lies inside the observed series")).cast("int")
        )
    ready = filled.select(
        *keys, DAY, "y", F.lit(True).alias("_train"), (gap + F.lit(days)).alias("_steps")
    )
    predicted = _run(ready, keys, "_steps", list(grid), rounds, tolerance)
    return predicted if first is None else predicted.filter(F.col(DAY) >= F.lit(first).cast("date"))


def smoothing_backtest(
    series: DataFrame,
    keys: Sequence[str] = (),
    *,
    ratio: float = 0.2,
    grid=GRID,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(keys, created, y_true, y_pred): the validation part, forecast in one go from the cut."""
    parts = interpolate_split(series, ratio, keys)
    held_out = parts.filter("split = 'val'")
    steps = F.count(F.when(F.col("split") == "val", 1)).over(W.partitionBy(*keys))
    ready = parts.select(
        *keys, DAY, "y", (F.col("split") == "train").alias("_train"), steps.alias("_steps")
    )
    predicted = _run(ready, keys, "_steps", list(grid), rounds, tolerance)
    actual = held_out.select(*keys, DAY, F.col("y").alias("y_true"))
    return actual.join(predicted.withColumnRenamed("prediction", "y_pred"), [*keys, DAY])

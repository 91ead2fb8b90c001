"""Multi-day forecasts: future panel rows, recursive model forecasts, commercial columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.functions import cyclical, threshold_flag, weekday_of
from dayloom.operators.baseline import check_horizon
from dayloom.operators.features import numeric_columns
from dayloom.operators.models import predicted, series_label, window_inputs
from dayloom.operators.trees import ensemble_value, is_ensemble, node_arrays
from dayloom.session import stage

DAY = "created"
COMMERCIAL = ("adSpend", "rcRevenue", "totalRevenue")


@dataclass(frozen=True)
class Recursion:
    """How future rows are built.

    ``mode='reference'`` feeds the model the ``window`` rows ending with the future day itself,
    whose target is still the carried one; ``mode='consistent'`` feeds the rows before it, as
    in training.
    """

    columns: Sequence[str]
    features: Sequence[str] = ()
    target: str = "orders"
    window: int = 28
    mode: str = "reference"
    at: Mapping[str, int] = field(init=False)

    def __post_init__(self) -> None:
        if self.mode not in ("reference", "consistent"):
            raise ValueError("mode must be 'reference' or 'consistent'")
        object.__setattr__(self, "at", {c: i for i, c in enumerate(self.columns)})

    @property
    def depth(self) -> int:
        """Rows a series has to remember: the window and the longest lag."""
        lags = [int(c.rsplit("_", 1)[1]) for c in self.columns if "_lag_" in c]
        return max([self.window, *lags])

    def next_row(self, rows: Column, day: Column, spend: Column, event: Column) -> Column:
        """Values of the row for ``day`` given the remembered rows.

        ``spend`` and ``event`` are maps of day to value, NULL where the caller gave none.
        Everything not named below repeats the last row.
        """
        last = F.element_at(rows, -1)

        def old(column: str, back: int = 1) -> Column:
            return F.try_element_at(rows, F.lit(-back))[self.at[column]]

        values = {c: last[i] for c, i in self.at.items()}
        weekday_sin, weekday_cos = cyclical(weekday_of(day), 7)
        month_sin, month_cos = cyclical(F.month(day), 12)
        dated = {
            "created_weekday": weekday_of(day).cast("double"),
            "created_month": F.month(day).cast("double"),
            "created_weekday_sin": weekday_sin,
            "created_weekday_cos": weekday_cos,
            "created_month_sin": month_sin,
            "created_month_cos": month_cos,
        }
        values.update({c: v for c, v in dated.items() if c in values})
        if "adSpend" in values:
            values["adSpend"] = F.coalesce(F.try_element_at(spend, day), values["adSpend"])
        for c in values:
            if "_lag_" in c:
                base, k = c.split("_lag_")
                source = self.target if base == "orders" else base
                if source in self.at:
                    values[c] = F.coalesce(old(source, int(k)), F.lit(0.0))
        for c, source in (("revenue_growth", "totalRevenue"), ("investment_growth", "adSpend")):
            if c in values and source in values:
                before = old(source)
                change = F.try_divide(values[source] - before, before)
                values[c] = F.coalesce(change, last[self.at[c]])
        given = event.isNotNull()

        def flag(d: Column) -> Column:
            return threshold_flag(F.coalesce(F.try_element_at(event, d), F.lit(0.0)))

        if "event_start" in values:
            values["event_start"] = F.when(given, flag(day)).otherwise(values["event_start"])
        if "event_start_next_1" in values:
            tomorrow = flag(F.date_add(day, 1))
            values["event_start_next_1"] = F.when(given, tomorrow).otherwise(F.lit(0.0))
        return F.array(*[values[c] for c in self.columns])

    def remember(self, rows: Column, row: Column) -> Column:
        grown = F.concat(rows, F.array(row))
        start = F.greatest(F.size(grown) - self.depth + 1, F.lit(1))
        return F.slice(grown, start, F.lit(self.depth))

    def model_input(self, rows: Column, row: Column) -> Column:
        """Flat time-major model input; missing values are 0."""
        seen = F.concat(rows, F.array(row)) if self.mode == "reference" else rows
        short = F.size(seen) < self.window
        tail = F.when(
            short, F.raise_error(F.lit("not enough history for the model window"))
        ).otherwise(F.slice(seen, F.size(seen) - self.window + 1, F.lit(self.window)))
        picks = [self.at[c] for c in self.features]
        chosen = F.transform(
            tail, lambda r: F.array(*[F.coalesce(F.nanvl(r[i], F.lit(0.0)), F.lit(0.0)) for i in picks])
        )
        return F.flatten(chosen)

    def with_target(self, row: Column, value: Column) -> Column:
        i = self.at[self.target]
        return F.transform(row, lambda v, j: F.when(j == i, value).otherwise(v))


def series_state(
    panel: DataFrame,
    plan: Recursion,
    keys: Sequence[str] = (),
    *,
    ad_spend: DataFrame | None = None,
    events: DataFrame | None = None,
    day: str = DAY,
) -> DataFrame:
    """One row per series: last day, the last ``plan.depth`` rows, and the override maps.

    Override tables hold (keys, created, value); an empty map stands for 'given, no such day'
    only if the table has rows at all, otherwise the maps are NULL.
    """
    recency = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(day).desc()))
    values = F.array(*[F.col(c).cast("double") for c in plan.columns])
    recent = panel.withColumn("_r", recency).filter(F.col("_r") <= plan.depth)
    state = recent.groupBy(*keys).agg(
        F.max(day).alias("_last"),
        F.sort_array(F.collect_list(F.struct(F.col(day).alias("d"), values.alias("v")))).alias("_h"),
    )
    state = state.select(*keys, "_last", F.transform("_h", lambda h: h["v"]).alias("_rows"))
    empty = F.lit(None).cast("map<date,double>")
    for name, table in (("_spend", ad_spend), ("_event", events)):
        if table is None:
            state = state.withColumn(name, empty)
            continue
        on = [k for k in keys if k in table.columns]
        # Only days to come are gathered: at most one entry per day of one horizon and series.
        ends = state.groupBy(*on).agg(F.min("_last").alias("_end"))
        ahead = F.when(F.col(DAY) > F.col("_end"), F.struct(DAY, "value"))
        entries = F.map_from_entries(F.collect_list(ahead)).alias(name)
        if on:
            state = state.join(table.join(ends, on).groupBy(*on).agg(entries), on, "left")
        else:
            dated = table.withColumn("_end", ends.select("_end").scalar())
            packed = dated.agg(entries, F.count(F.lit(1)).alias("_n")).filter("_n > 0").select(name)
            state = state.withColumn(name, packed.scalar())
        # Only days to come can be asked for; a map without any stays a map.
        state = state.withColumn(name, F.map_filter(name, lambda d, _: d > F.col("_last")))
    return state


def _horizon(last: Column, first: str | None, days: int) -> tuple[Column, Column]:
    """(first predicted day, all days to build) of a series."""
    check_horizon(days)
    begin = F.date_add(last, 1)
    if first is not None:
        asked = F.lit(first).cast("date")
        begin = F.when(asked > last, asked).otherwise(
            F.raise_error(F.lit("the first day lies inside the observed series"))
        )
    return begin, F.sequence(F.date_add(last, 1), F.date_add(begin, days - 1))


def _unfold(built: DataFrame, plan: Recursion, keys: Sequence[str]) -> DataFrame:
    exploded = built.select(*keys, "_last", F.explode("_out").alias("o"))
    return exploded.select(
        *keys,
        F.col("o.day").alias(DAY),
        F.col("_last").alias("series_last_date"),
        F.col("o.prediction").alias("prediction"),
        *[F.col("o.row")[i].alias(c) for c, i in plan.at.items()],
    )


def _fold(state: DataFrame, plan: Recursion, first, days: int, keys, predict) -> DataFrame:
    """Build all future rows of a series in one expression: a fold over its future days."""
    begin, horizon = _horizon(F.col("_last"), first, days)
    out_type = "array<struct<day: date, prediction: double, row: array<double>>>"
    staged = state.withColumns({"_begin": begin, "_days": horizon})

    def step(acc: Column, day: Column) -> Column:
        fresh = plan.next_row(acc["rows"], day, F.col("_spend"), F.col("_event"))

        def finish(row: Column) -> Column:
            asked = day >= F.col("_begin")
            value = (
                F.when(asked, predict(plan.model_input(acc["rows"], row)))
                if predict
                else F.lit(None).cast("double")
            )

            def close(p: Column) -> Column:
                final = F.when(p.isNull(), row).otherwise(plan.with_target(row, p))
                entry = F.struct(day.alias("day"), p.alias("prediction"), final.alias("row"))
                return F.struct(
                    plan.remember(acc["rows"], final).alias("rows"),
                    F.concat(acc["out"], F.array(entry)).alias("out"),
                )

            return F.transform(F.array(value), close)[0]

        # A one-element transform names an intermediate value, so it is computed once.
        return F.transform(F.array(fresh), finish)[0]

    zero = F.struct(F.col("_rows").alias("rows"), F.array().cast(out_type).alias("out"))
    folded = F.aggregate("_days", zero, step, lambda acc: acc["out"])
    out = F.filter(folded, lambda o: o["day"] >= F.col("_begin")) if predict else folded
    return _unfold(staged.withColumn("_out", out), plan, keys)


def future_panel(
    panel: DataFrame,
    days: int,
    keys: Sequence[str] = (),
    *,
    target: str = "orders",
    first: str | None = None,
    ad_spend: DataFrame | None = None,
    events: DataFrame | None = None,
) -> DataFrame:
    """Panel rows of the days after each series' end, target carried forward (no model)."""
    columns = numeric_columns(panel, without=keys)
    plan = Recursion(columns, columns, target)
    state = series_state(panel, plan, keys, ad_spend=ad_spend, events=events)
    return _fold(state, plan, first, days, keys, None).drop("prediction")


def recursive_forecast(
    panel: DataFrame,
    model,
    days: int,
    keys: Sequence[str] = (),
    *,
    features: Sequence[str] | None = None,
    target: str = "orders",
    window: int | None = None,
    first: str | None = None,
    ad_spend: DataFrame | None = None,
    events: DataFrame | None = None,
    mode: str = "reference",
    steps_per_cut: int = 2,
) -> DataFrame:
    """Day-by-day forecast of a window model, each prediction feeding the following days.

    Inputs are taken by name: ``features`` and ``window``, by default those the model was fitted
    with, whatever columns the panel has besides and in whatever order. Features the panel lacks
    are 0. A model of another input length, or one that does not know its inputs while none are
    given, raises.

    All series advance together. A linear model and an ensemble of trees, as node arrays, are folded
    over the future days inside one projection. Any other fitted model transforms one row per series
    and day step; the steps are narrow (no shuffle), and every ``steps_per_cut`` of them the finished
    rows are written out. A pooled model with a series index gets the series of each row by its keys.
    """
    features = list(features or getattr(model, "feature_columns", None) or [])
    window = window or getattr(model, "window", None) or 28
    if not features:
        raise ValueError("the model does not know its inputs; name them in features")
    if window_inputs(model) != len(features) * window:
        raise ValueError(f"{window_inputs(model)} model inputs, but {len(features)} features x {window}")
    absent = [c for c in features if c not in panel.columns]
    panel = panel.withColumns({c: F.lit(0.0) for c in absent}) if absent else panel
    columns = numeric_columns(panel, without=keys)
    plan = Recursion(columns, features, target, window, mode)
    state = series_state(panel, plan, keys, ad_spend=ad_spend, events=events)
    index = getattr(model, "series_index", None)
    if index is not None and set(index.keys) - set(keys):
        raise ValueError(f"the model tells series apart by {list(index.keys)}")
    if hasattr(model, "coefficients"):
        every = [float(w) for w in model.coefficients.toArray()]
        size = len(features) * window
        weights = F.array(*[F.lit(w) for w in every[:size]])
        state = state.withColumn("_bias", F.lit(float(model.intercept)))
        if index is not None:
            state = state.withColumn("_bias", F.col("_bias") + _by_series(index, every[size:], 0.0))

        def predict(x: Column) -> Column:
            products = F.zip_with(x, weights, lambda a, b: a * b)
            return F.aggregate(products, F.col("_bias"), lambda s, v: s + v)

        return _fold(state, plan, first, days, keys, predict)
    if is_ensemble(model):
        trees = node_arrays(panel.sparkSession, model)
        state = state.withColumn("_trees", trees.scalar())
        if index is not None:
            numbers = [float(i) for i in range(len(index.labels))]
            state = state.withColumn("_series", _by_series(index, numbers, float(len(numbers))))

        def predict(x: Column) -> Column:
            seen = F.concat(x, F.array("_series")) if index is not None else x
            return ensemble_value(model, F.col("_trees"), seen)

        return _fold(state, plan, first, days, keys, predict)
    return _stepwise(state, plan, model, first, days, keys, steps_per_cut)


def _by_series(index, values: Sequence[float], unseen: float) -> Column:
    """The value of a row's series; ``unseen`` for one the model does not know."""
    labels = F.array(*[F.lit(t) for t in index.labels])
    place = F.array_position(labels, series_label(index.keys)).cast("int")
    found = F.get(F.array(*[F.lit(v) for v in values]), place - 1)
    return F.coalesce(F.when(place > 0, found), F.lit(unseen))


def _stepwise(state, plan, model, first, days, keys, steps_per_cut) -> DataFrame:
    begin, horizon = _horizon(F.col("_last"), first, days)
    out_type = "array<struct<day: date, prediction: double, row: array<double>>>"
    current = stage(
        state.withColumns(
            {"_begin": begin, "_end": F.element_at(horizon, -1), "_out": F.array().cast(out_type)}
        )
    )
    steps = current.agg(F.max(F.datediff("_end", "_last"))).first()[0] or 0
    base, done = current.columns, []
    for i in range(1, steps + 1):
        day = F.date_add("_last", i)
        row = plan.next_row(F.col("_rows"), day, F.col("_spend"), F.col("_event"))
        ready = current.withColumns({"_day": day, "_row": row})
        ready = ready.withColumn(
            model.getFeaturesCol(),
            array_to_vector(plan.model_input(F.col("_rows"), F.col("_row"))),
        )
        scored = predicted(model, ready)
        asked = (F.col("_day") >= F.col("_begin")) & (F.col("_day") <= F.col("_end"))
        scored = scored.withColumn("_p", F.when(asked, F.col(model.getPredictionCol())))
        scored = scored.withColumn(
            "_row",
            F.when(F.col("_p").isNull(), F.col("_row")).otherwise(
                plan.with_target(F.col("_row"), F.col("_p"))
            ),
        )
        entry = F.struct(
            F.col("_day").alias("day"), F.col("_p").alias("prediction"), F.col("_row").alias("row")
        )
        current = scored.withColumns(
            {
                "_rows": plan.remember(F.col("_rows"), F.col("_row")),
                "_out": F.when(asked, F.concat("_out", F.array(entry))).otherwise(F.col("_out")),
            }
        ).select(*base)
        if i % steps_per_cut == 0 and i < steps:
            # Finished rows stay in this chunk's files; only the state goes on.
            current = stage(current)
            done.append(_unfold(current, plan, keys))
            current = current.withColumn("_out", F.array().cast(out_type))
    whole = _unfold(current, plan, keys)
    for part in done:
        whole = whole.unionByName(part)
    return whole


def fill_commercial(
    forecast: DataFrame,
    panel: DataFrame,
    keys: Sequence[str] = (),
    *,
    only_missing: bool = True,
    day: str = DAY,
) -> DataFrame:
    """Spend and revenue of forecast days: the panel's row of that day, after its last day the
    last row's values, inside a gap NULL. Rounded to cents; present values stay unless
    ``only_missing`` is off.
    """
    have = [c for c in COMMERCIAL if c in panel.columns]
    dated = panel.filter(F.col(day).isNotNull())
    values = F.struct(*[F.round(F.col(c).cast("double"), 2).alias(c) for c in have])
    exact = dated.select(*keys, day, values.alias("_exact"))
    newest = dated.groupBy(*keys).agg(
        F.max(day).alias("_until"), F.max_by(values, day).alias("_tail")
    )
    joined = forecast.join(exact, [*keys, day], "left")
    if keys:
        joined = joined.join(newest, list(keys), "left")
    else:
        tail = newest.select(F.struct("_until", "_tail")).scalar()
        joined = joined.withColumns({"_until": tail["_until"], "_tail": tail["_tail"]})
    found = F.when(F.col("_exact").isNotNull(), F.col("_exact")).when(
        F.col(day) > F.col("_until"), F.col("_tail")
    )
    updates = {}
    for c in COMMERCIAL:
        value = found[c] if c in have else F.lit(None).cast("double")
        if only_missing and c in forecast.columns:
            value = F.coalesce(F.round(F.col(c), 2), value)
        updates[c] = value
    return joined.withColumns(updates).drop("_exact", "_until", "_tail")

"""Prediction errors, metrics, error distributions and model selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.functions import as_column, bucket_of, clean_number, days_since, finite, same_text
from dayloom.operators.calendar import drop_open_day

DAY = "created"

# Model names in registration order; earlier names win ties.
MODEL_ORDER = (
    "linear_regression",
    "ridge",
    "random_forest",
    "xgboost",
    "catboost",
    "lstm",
    "baseline_tm7_sw8_blend",
    "sarima",
    "exponential_smoothing",
    "neuralprophet",
    "temporal_fusion_transformer",
)

# Histogram bins, shared range of squared errors, display limits in percent.
HISTOGRAM_BINS = 60
SQUARED_ERROR_RANGE = (0.0, 9.6e6)
PCT_LIMITS = (-100.0, 100.0)
SMOOTHED_PCT_LIMITS = (-60.0, 200.0)
KDE_POINTS = 200

_SQUARED = ("rmse", "squared_error", "sq_error", "squared_residual")
_ABSOLUTE = ("abs_error", "absolute_error", "ae")


def ape(actual: Column | str = "y_true", predicted: Column | str = "y_pred") -> Column:
    """Absolute error as a share of the actual value (at least 1e-8)."""
    actual, predicted = as_column(actual), as_column(predicted)
    return F.abs(actual - predicted) / F.greatest(F.abs(actual), F.lit(1e-8))


def metric_columns(actual: str = "y_true", predicted: str = "y_pred") -> list[Column]:
    error = F.col(actual) - F.col(predicted)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(ape(actual, predicted)).alias("mape"),
    ]


def metrics_by_model(errors: DataFrame, groups: Sequence[str] = ("model",)) -> DataFrame:
    """MAE, RMSE and MAPE (a proportion) per group."""
    return errors.groupBy(*groups).agg(*metric_columns(), F.count(F.lit(1)).alias("n"))


def error_rows(
    predictions: DataFrame,
    model: str | Column,
    keys: Sequence[str] = (),
    *,
    order: str = DAY,
) -> DataFrame:
    """(model, keys, sample_idx, y_true, y_pred, mape, day); rows without a finite error drop.

    ``sample_idx`` numbers a series' rows before that, so it keeps its gaps.
    """
    name = F.lit(model) if isinstance(model, str) else model
    if "sample_idx" in predictions.columns:
        numbered = predictions
    else:
        w = W.partitionBy(name, *keys).orderBy(order)
        numbered = predictions.withColumn("sample_idx", (F.row_number().over(w) - 1).cast("bigint"))
    dated = [DAY] if DAY in predictions.columns else []
    rows = numbered.select(
        name.alias("model"),
        *keys,
        "sample_idx",
        F.col("y_true").cast("double").alias("y_true"),
        F.col("y_pred").cast("double").alias("y_pred"),
        finite(ape()).alias("mape"),
        *dated,
    )
    return rows.dropna(subset=["mape"])


def only_models(errors: DataFrame, models: Sequence[str] | None) -> DataFrame:
    """Rows of the named models, compared without regard to case."""
    if models is None:
        return errors
    return errors.filter(F.lower("model").isin([m.lower() for m in models]))


def _per_model(errors: DataFrame, models: Sequence[str] | None, *stats: Column) -> DataFrame:
    """Join per-model statistics to the rows.

    With a list of models the statistics have at most that many rows, so they are broadcast;
    without one the join is left to the optimizer, which checks the size itself.
    """
    kept = only_models(errors, models)
    table = kept.groupBy("model").agg(*stats)
    return kept.join(F.broadcast(table) if models else table, "model")


def metric_values(
    table: DataFrame,
    metric: str = "mape",
    *,
    models: Sequence[str] | None = None,
    model_column: str = "model",
) -> DataFrame:
    """(model, value): numeric values of a metric; MAPE proportions (max 1.5) become percent."""
    values = table.select(
        F.col(model_column).alias("model"), table[metric].try_cast("double").alias("value")
    ).dropna(subset=["value"])
    if metric.lower() != "mape":
        return only_models(values, models)
    scaled = _per_model(values, models, F.max(F.abs("value")).alias("_top"))
    percent = F.when(F.col("_top") <= 1.5, F.col("value") * 100.0).otherwise(F.col("value"))
    return scaled.select("model", percent.alias("value"))


def error_values(
    errors: DataFrame, kind: str, *, models: Sequence[str] | None = None
) -> DataFrame:
    """(model, value) by name: squared errors, absolute errors, or any stored column."""
    key = kind.strip().lower()
    if key not in (*_SQUARED, *_ABSOLUTE):
        return metric_values(errors, kind, models=models)
    error = clean_number("y_true") - clean_number("y_pred")
    value = error * error if key in _SQUARED else F.abs(error)
    return (
        only_models(errors, models)
        .select("model", value.alias("value"))
        .dropna(subset=["value"])
    )


def shared_range(kind: str) -> tuple[float, float] | None:
    """The range all models share: squared errors only."""
    return SQUARED_ERROR_RANGE if kind.strip().lower() in _SQUARED else None


def histogram(
    values: DataFrame,
    *,
    models: Sequence[str] | None = None,
    bins: int = HISTOGRAM_BINS,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """(model, bin, low, high, n), one row per bin including empty ones.

    Without ``limits`` each model spans its own values, or half a unit around them if they are
    all equal. Values outside are not counted; the last bin owns its right edge.
    """
    bounds = [F.min("value").alias("_min"), F.max("value").alias("_max")]
    if limits is None:
        spanned = _per_model(values, models, *bounds)
        alone = F.col("_min") == F.col("_max")
        low = F.col("_min") - F.when(alone, 0.5).otherwise(0.0)
        high = F.col("_max") + F.when(alone, 0.5).otherwise(0.0)
    else:
        spanned = only_models(values, models)
        low, high = F.lit(float(limits[0])), F.lit(float(limits[1]))
    placed = spanned.select("model", "value", low.alias("_low"), high.alias("_high"))
    counts = (
        placed.select(
            "model", "_low", "_high", bucket_of("value", "_low", "_high", bins).alias("bin")
        )
        .groupBy("model", "_low", "_high", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_model = counts.groupBy("model", "_low", "_high").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))
        ).alias("_n")
    )
    width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    frame = per_model.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.select(
        "model",
        "bin",
        (F.col("_low") + width * F.col("bin")).alias("low"),
        (F.col("_low") + width * (F.col("bin") + 1)).alias("high"),
        F.coalesce(F.try_element_at("_n", F.col("bin")), F.lit(0)).cast("bigint").alias("n"),
    )


def density(
    values: DataFrame,
    *,
    models: Sequence[str] | None = None,
    points: int = KDE_POINTS,
    bins: int = HISTOGRAM_BINS,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Gaussian kernel density on an even grid, scaled to histogram counts.

    The bandwidth is ``n ** -0.2`` sample standard deviations. Models with fewer than two
    values or no spread give no curve. Every value contributes only to the grid points at which
    its kernel does not underflow to 0, and contributions are summed map-side, so a hot model
    never travels as rows.
    """
    stats = [
        F.count(F.lit(1)).alias("_n"),
        F.stddev_samp("value").alias("_std"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
    ]
    merged = only_models(values, models).groupBy("model", "value").agg(
        F.count(F.lit(1)).alias("_copies")
    )
    table = only_models(values, models).groupBy("model").agg(*stats)
    joined = merged.join(F.broadcast(table) if models else table, "model")
    usable = joined.filter((F.col("_n") >= 2) & (F.col("_std") > 1e-8))
    low = F.col("_min") if limits is None else F.lit(float(limits[0]))
    high = F.col("_max") if limits is None else F.lit(float(limits[1]))
    n = F.col("_n").cast("double")
    step = (high - low) / F.lit(float(points - 1))
    sized = usable.select(
        "model",
        "value",
        "_copies",
        n.alias("_n"),
        (F.col("_std") * F.pow(n, F.lit(-0.2))).alias("_h"),
        low.alias("_low"),
        step.alias("_step"),
        ((high - low) / F.lit(float(bins))).alias("_bin"),
    )
    # exp(-z * z / 2) is exactly 0 in double precision beyond |z| = 38.7.
    reach = F.col("_h") * 39.0
    from_point = F.greatest(
        F.lit(0), F.floor((F.col("value") - reach - F.col("_low")) / F.col("_step")).cast("int")
    )
    to_point = F.least(
        F.lit(points - 1),
        F.ceil((F.col("value") + reach - F.col("_low")) / F.col("_step")).cast("int"),
    )
    touched = sized.withColumns({"_from": from_point, "_to": to_point}).filter("_from <= _to")
    spread = touched.select("*", F.explode(F.sequence("_from", "_to")).alias("point"))
    z = (F.col("_low") + F.col("_step") * F.col("point") - F.col("value")) / F.col("_h")
    # density * n * bin width: the n cancels.
    weight = F.col("_copies") * F.exp(z * z * -0.5) * F.col("_bin") / (
        F.col("_h") * F.lit(2.5066282746310002)
    )
    return spread.groupBy("model", "point").agg(
        F.max(F.col("_low") + F.col("_step") * F.col("point")).alias("x"),
        F.sum(weight).alias("y"),
    )


def true_vs_pred(
    errors: DataFrame,
    model: str,
    *,
    keys: Sequence[str] = (),
    only: Mapping[str, str] | None = None,
) -> DataFrame:
    """(keys, x, y_true, y_pred, mape_pct) of one model, ``x`` counting days from the first.

    Without any dates ``x`` numbers the rows by ``sample_idx``. ``only`` restricts key columns
    to a value. ``mape_pct`` is that of the whole series.
    """
    rows = errors.filter(same_text("model", model))
    for column, value in (only or {}).items():
        if column in rows.columns:
            rows = rows.filter(F.col(column).cast("string") == str(value))
    rows = rows.withColumns(
        {"y_true": clean_number("y_true"), "y_pred": clean_number("y_pred")}
    ).dropna(subset=["y_true", "y_pred"])
    whole = W.partitionBy(*keys)
    number = (F.row_number().over(whole.orderBy("sample_idx")) - 1).cast("double")
    if DAY in rows.columns:
        dated = F.count(DAY).over(whole) > 0
        offset = days_since(DAY, F.min(DAY).over(whole)).cast("double")
        placed = rows.withColumn("x", F.when(dated, offset).otherwise(number)).filter(
            F.col("x").isNotNull()
        )
    else:
        placed = rows.withColumn("x", number)
    mape_pct = F.avg(ape() * 100.0).over(whole)
    return placed.select(*keys, "x", "y_true", "y_pred", mape_pct.alias("mape_pct"))


def mean_of(table: DataFrame, column: str = "y_true") -> DataFrame:
    """Mean and number of the numeric values of a column."""
    value = table[column].try_cast("double")
    known = F.when(~F.isnan(value), value)
    return table.agg(F.avg(known).alias(f"mean_{column}"), F.count(known).alias("n"))


def select_best(
    metrics: DataFrame, metric: str = "mae", order: Sequence[str] = MODEL_ORDER
) -> DataFrame:
    """The model with the smallest finite metric; ties go to the earlier name in ``order``.

    Models with an error, without the metric, or not listed in ``order`` do not take part.
    """
    rank = F.create_map(*[x for i, m in enumerate(order) for x in (F.lit(m), F.lit(i))])
    value = finite(F.col(metric).cast("double"))
    entrants = metrics.filter(
        rank[F.col("model")].isNotNull() & value.isNotNull()
    )
    if "error" in metrics.columns:
        entrants = entrants.filter(F.col("error").isNull())
    best = F.min(F.struct(value.alias("v"), rank[F.col("model")].alias("r"), "model")).alias("b")
    return (
        entrants.agg(best)
        .filter(F.col("b").isNotNull())
        .select(
            F.col("b.model").alias("model_name"),
            F.lit(metric).alias("metric_name"),
            F.col("b.v").alias("metric_value"),
        )
    )


def clipped_days(
    changes: DataFrame, column: str, limits: tuple[float, float] = PCT_LIMITS
) -> DataFrame:
    """Display limits of a percentage series and the number of days beyond them."""
    low, high = limits
    return changes.agg(
        F.count(column).alias("n_points"),
        F.lit(float(low)).alias("y_low"),
        F.lit(float(high)).alias("y_high"),
        F.count_if((F.col(column) < low) | (F.col(column) > high)).alias("n_clipped"),
    )


def series_report(
    daily: DataFrame, events: DataFrame, plotted: DataFrame | None = None
) -> DataFrame:
    """One row: days before and after dropping the open day, points shown, events total and in range.

    ``daily`` is the untrimmed series, ``plotted`` what is shown (default: the trimmed series).
    """
    trimmed = drop_open_day(daily)
    shown = trimmed if plotted is None else plotted
    span = shown.agg(
        F.struct(
            F.min(DAY).alias("first"), F.max(DAY).alias("last"), F.count(F.lit(1)).alias("n")
        )
    ).scalar()
    raw = daily.agg(F.count(F.lit(1))).scalar()
    inside = (F.col("startDate") >= span["first"]) & (F.col("startDate") <= span["last"])
    return events.agg(
        F.count_if(inside).alias("n_events_in_range"),
        F.count(F.lit(1)).alias("n_events_total"),
    ).select(
        span["n"].alias("n_points_plotted"),
        (raw - 1).alias("n_days_raw"),
        raw.alias("n_days_before_trim"),
        "n_events_in_range",
        "n_events_total",
    )

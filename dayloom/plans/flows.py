"""End-to-end compositions: datasets to panel, training run, winner forecast."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators.baseline import Blend, baseline_forecast
from dayloom.operators.calendar import target_series, trim_last_day
from dayloom.operators.daily import combined_daily, daily_order_stats
from dayloom.operators.features import feature_panel
from dayloom.operators.forecast import COMMERCIAL, fill_commercial, recursive_forecast
from dayloom.operators.models import (
    Comparison,
    compare_models,
    load_winner,
    promote,
    stored_panel,
)
from dayloom.operators.smoothing import smoothing_forecast
from dayloom.operators.windows import require_windows, training_vectors
from dayloom.sources.files import metrics_json, write_dataset, write_datasets, write_record
from dayloom.sources.tables import (
    HISTORY_START,
    scan_ad_spends,
    scan_event_days,
    scan_order_lines,
)

DAY = "created"
# Winners that react to future spend and event overrides.
OVERRIDABLE = ("linear_regression", "ridge", "random_forest", "catboost", "xgboost", "lstm")


def build_datasets(
    orders: DataFrame,
    spends: DataFrame,
    events: DataFrame,
    base: str,
    *,
    since: str = HISTORY_START,
    fmt: str = "parquet",
) -> dict[str, dict[str, str]]:
    """Scan the three source tables from ``since`` on and write them typed below ``base``."""
    tables = {
        "orders": scan_order_lines(orders, since=since),
        "ad_spends": scan_ad_spends(spends, since=since),
        "events": scan_event_days(events, since=since),
    }
    return write_datasets(tables, base, fmt)


def daily_panel(
    lines: DataFrame,
    spends: DataFrame,
    events: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Order lines, daily spend and event days to the combined panel without its open last day."""
    stats = daily_order_stats(lines, keys)
    return trim_last_day(combined_daily(stats, spends, events, keys), keys)


def build_features(
    lines: DataFrame,
    spends: DataFrame,
    events: DataFrame | None = None,
    keys: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Raw tables to the feature panel in one lazy plan."""
    return feature_panel(daily_panel(lines, spends, events, keys), keys, **options)


def train_and_promote(
    panel: DataFrame,
    keys: Sequence[str] = (),
    *,
    target: str = "orders",
    window: int = 28,
    ratio: float = 0.2,
    metric: str = "mae",
    models: Iterable[str] | None = None,
    options: Mapping[str, Any] | None = None,
    seed: int = 42,
    path: str | None = None,
) -> tuple[Comparison, DataFrame]:
    """Windows, comparison, selection and promotion; returns the comparison and winner record.

    With ``path``, metrics, prediction errors, the winner record and its model are stored there.
    """
    panel = stored_panel(panel)
    windows = require_windows(
        training_vectors(panel, target=target, window=window, ratio=ratio, keys=keys)
    )
    comparison = compare_models(
        windows,
        panel,
        keys,
        target=target,
        ratio=ratio,
        models=models,
        options=options,
        seed=seed,
    )
    if path is not None:
        write_record(metrics_json(comparison.metrics), f"{path}/metrics.json")
        if comparison.errors is not None:
            write_dataset(comparison.errors, path, "mape_distribution", "jsonl")
    return comparison, promote(comparison, target, path, metric)


def forecast_winner(
    winner: Mapping[str, Any],
    model: Any,
    panel: DataFrame,
    days: int,
    keys: Sequence[str] = (),
    *,
    first: str | None = None,
    target: str = "orders",
    features: Sequence[str] | None = None,
    window: int | None = None,
    ad_spend: DataFrame | None = None,
    events: DataFrame | None = None,
) -> DataFrame:
    """Forecast with the promoted model, commercial columns and provenance attached.

    ``features`` and ``window`` default to what the winner record or the model itself says.
    """
    name = winner["model_name"]
    if name == "baseline_tm7_sw8_blend":
        series = target_series(panel, target, keys, complete=False)
        spec = model if isinstance(model, Blend) else Blend()
        daily = baseline_forecast(series, days, keys, first=first, spec=spec)
        components = ["trailing_mean_7", "same_weekday_median_8w"]
    elif name == "exponential_smoothing":
        series = target_series(panel, target, keys)
        last = series.groupBy(*keys).agg(F.max(DAY).alias("series_last_date"))
        daily = smoothing_forecast(series, days, keys, first=first)
        if keys:
            daily = daily.join(last, list(keys))
        else:
            daily = daily.withColumn("series_last_date", last.scalar())
        components = []
    elif name in OVERRIDABLE and model is not None:
        daily = recursive_forecast(
            panel,
            model,
            days,
            keys,
            features=features or winner.get("features"),
            target=target,
            window=window or winner.get("window"),
            first=first,
            ad_spend=ad_spend,
            events=events,
        )
        components = [c for c in COMMERCIAL if c in daily.columns]
    else:
        raise ValueError(f"no forecast for the winning model {name!r}")
    cents = [F.round(c, 2).alias(c) for c in ("prediction", *components)]
    shaped = daily.select(*keys, DAY, "series_last_date", *cents)
    return fill_commercial(shaped, panel, keys).withColumns(
        {
            "model_name": F.lit(name),
            "metric_name": F.lit(winner.get("metric_name")).cast("string"),
            "metric_value": F.lit(winner.get("metric_value")).cast("double"),
            "target_col": F.lit(target),
            "future_ad_spend_provided": F.lit(ad_spend is not None),
            "future_events_provided": F.lit(events is not None),
            "future_overrides_supported": F.lit(name in OVERRIDABLE),
        }
    )


def forecast_stored(path: str, panel: DataFrame, days: int, keys: Sequence[str] = (), **options) -> DataFrame:
    """Forecast with the winner that :func:`train_and_promote` stored below ``path``."""
    winner, model = load_winner(panel.sparkSession, path)
    return forecast_winner(
        winner, model, panel, days, keys, target=winner["target_col"] or "orders", **options
    )

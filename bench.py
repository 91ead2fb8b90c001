"""Headline timings: one JSON line, the median of warm runs, every result fully materialised."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from dayloom.operators import (
    baseline,
    calendar,
    daily,
    features,
    forecast,
    models,
    profile,
    smoothing,
    windows,
)
from dayloom.operators.daily import DAY
from dayloom.plans import forecast_queries, oracle
from dayloom.plans.oracle import BRAND
from dayloom.session import build_session
from dayloom.sources.retail import Retail

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def part_series(retail):
    lines = retail.order_lines().groupBy("productId", DAY)
    return lines.agg(F.count(F.lit(1)).cast("double").alias("y"))


def ridge(retail):
    framed = windows.training_vectors(models.stored_panel(retail.panel()), list(oracle.FEATURES))
    train, validation = models.prepared_windows(framed, 0.2)
    fitted = models.fit_window_model("ridge", train)
    return models.validation_errors("ridge", fitted, validation)


def recursion(retail):
    panel = models.stored_panel(retail.panel())
    framed = windows.training_vectors(panel, list(oracle.FEATURES))
    train, _ = models.prepared_windows(framed, 0.2)
    return forecast.recursive_forecast(panel, models.fit_window_model("ridge", train), 14)


def forest(retail):
    framed = windows.training_vectors(models.stored_panel(retail.panel()), list(oracle.FEATURES))
    train, validation = models.prepared_windows(framed, 0.2)
    fitted = models.fit_window_model("random_forest", train, {"random_forest_n_estimators": 10})
    return models.validation_errors("random_forest", fitted, validation)


BENCHES = {
    "daily_orders": lambda r: daily.daily_counts(r.order_facts(), weight="lines"),
    "order_numbers": lambda r: r.order_facts(numbered=True),
    "product_daily_units": lambda r: r.product_days(),
    "combined_daily": lambda r: r.combined(),
    "combined_daily_by_brand": lambda r: r.combined(BRAND),
    "feature_panel": lambda r: r.panel(BRAND),
    "baseline_forecast": lambda r: baseline.baseline_forecast(r.series(), 14),
    "baseline_forecast_by_part": lambda r: baseline.baseline_forecast(
        part_series(r), 14, ["productId"]
    ),
    "baseline_backtest": lambda r: baseline.baseline_backtest(part_series(r), ["productId"]),
    "baseline_grid": lambda r: baseline.baseline_grid(
        r.series(BRAND), models.expand_grid(forecast_queries.BASELINE_GRID), [BRAND]
    ),
    "sliding_windows": lambda r: windows.sliding_windows(
        r.panel(BRAND), list(oracle.FEATURES), keys=[BRAND]
    ),
    "window_scaler": lambda r: windows.window_scaler(
        r.panel(BRAND), list(oracle.FEATURES), keys=[BRAND]
    ),
    "pct_change_ma7": lambda r: features.pct_change_smoothed(r.series(BRAND), "y", [BRAND]),
    "error_metrics": lambda r: forecast_queries.metrics_by_model(r.spark, r.folder),
    "ridge_backtest": ridge,
    "profile": lambda r: profile.profile(r.combined().drop("created")),
    "smoothing_forecast": lambda r: smoothing.smoothing_forecast(
        calendar.complete_calendar(r.series(BRAND), [BRAND]), 14, [BRAND]
    ),
    "recursive_forecast": recursion,
    "forest_fit_10_trees": forest,
}


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # Window stages of a few megabytes are CPU-bound: keep them spread over all cores.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or list(BENCHES)
    seconds = {}
    for name in chosen:
        runs = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            frame = BENCHES[name](Retail(spark, FOLDER))
            frame.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    total = round(sum(seconds.values()), 3)
    record = {
        "metric": "total_seconds_headline_queries",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(record), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

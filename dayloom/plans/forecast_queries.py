"""Queries: baseline, evaluation, selection, forecasts, models, streaming."""

from __future__ import annotations


from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dayloom.operators import (
    baseline,
    calendar,
    evaluate,
    forecast,
    importance,
    models,
    smoothing,
    windows,
)
from dayloom.operators.daily import DAY
from dayloom.plans import flows
from dayloom.plans import oracle as o
from dayloom.plans.catalog import query, tidy
from dayloom.plans.oracle import BRAND, r6, with_
from dayloom.session import staged_path
from dayloom.sources import files, overrides
from dayloom.sources.retail import Retail
from dayloom.streaming import closed_days

RATIO = 0.2
HORIZON = 14
_COMPONENTS = ("trailing_mean_7", "same_weekday_median_8w")


@query(
    "tm7_sw8_components",
    with_(
        o.series(BRAND) + ",\n" + o.components(BRAND),
        f"SELECT p_brand, created, y, {', '.join(r6(c) for c in _COMPONENTS)} FROM components",
    ),
)
def tm7_sw8_components(spark, folder):
    return tidy(baseline.with_components(Retail(spark, folder).series(BRAND), [BRAND]))


def _backtest_sql(key):
    doubles = ("y_true", *_COMPONENTS, "y_pred")
    return with_(
        o.backtest(key),
        f"""SELECT {o.key_list(key)}sample_idx, created, {', '.join(r6(c) for c in doubles)}
FROM backtest""",
    )


@query("baseline_backtest", _backtest_sql(BRAND))
def baseline_backtest(spark, folder):
    return tidy(baseline.baseline_backtest(Retail(spark, folder).series(BRAND), [BRAND]))


@query("baseline_backtest_by_part", _backtest_sql("l_partkey"))
def baseline_backtest_by_part(spark, folder):
    units = Retail(spark, folder).order_lines()
    daily = units.groupBy(F.col("productId").alias("l_partkey"), DAY).agg(
        F.count(F.lit(1)).cast("double").alias("y")
    )
    return tidy(baseline.baseline_backtest(daily, ["l_partkey"]))


def _forecast_sql(key, days=HORIZON):
    by = f"{key} AND " if key else ""
    on = f"s.{key} = l.{key}" if key else "TRUE"
    group = f"GROUP BY {key}" if key else ""
    pick = f"l.{key}, " if key else ""
    return (
        o.series(key)
        + f""", lasts AS (SELECT {o.key_list(key)}max(created) AS last FROM series {group}),
horizon AS (
  SELECT *, unnest(generate_series((last + 1)::TIMESTAMP, (last + {days})::TIMESTAMP,
    INTERVAL 1 DAY))::DATE AS created FROM lasts),
forecast AS (
  SELECT {pick}l.created, l.last AS series_last_date,
    avg(y) FILTER (s.created > l.last - 7) AS trailing_mean_7,
    quantile_cont(y, 0.5) FILTER (s.created > l.last - 56
      AND isodow(s.created) = isodow(l.created)) AS same_weekday_median_8w
  FROM horizon l JOIN series s ON {on} GROUP BY ALL),
blended AS (
  SELECT *, coalesce(0.45::DOUBLE * trailing_mean_7 + 0.55::DOUBLE * same_weekday_median_8w,
    trailing_mean_7, same_weekday_median_8w) AS prediction FROM forecast)"""
    )


def _forecast_select(key):
    doubles = (*_COMPONENTS, "prediction")
    return f"""SELECT {o.key_list(key)}created, series_last_date,
  {', '.join(r6(c) for c in doubles)} FROM blended"""


@query("baseline_forecast", with_(_forecast_sql(None), _forecast_select(None)))
def baseline_forecast(spark, folder):
    return tidy(baseline.baseline_forecast(Retail(spark, folder).series(), HORIZON))


@query("baseline_forecast_by_brand", with_(_forecast_sql(BRAND), _forecast_select(BRAND)))
def baseline_forecast_by_brand(spark, folder):
    series = Retail(spark, folder).series(BRAND)
    return tidy(baseline.baseline_forecast(series, HORIZON, [BRAND]))


@query(
    "forecast_commercial",
    with_(
        o.combined(BRAND)
        + ",\n"
        + _forecast_sql(BRAND, 120)
        + """, tails AS (
  SELECT p_brand, max(created) AS until, arg_max(adSpend, created) AS a,
    arg_max(rcRevenue, created) AS r, arg_max(totalRevenue, created) AS t
  FROM combined GROUP BY p_brand)""",
        "SELECT b.p_brand, b.created, "
        + r6("prediction")
        + ", "
        + ", ".join(
            f"""round((CASE WHEN c.created IS NOT NULL THEN c.{n}
    WHEN b.created > until THEN {a} END)::DECIMAL(24, 4), 2)::DOUBLE AS {n}"""
            for n, a in zip(o.MONEY, "art")
        )
        + """
FROM blended b JOIN tails USING (p_brand)
LEFT JOIN combined c ON c.p_brand = b.p_brand AND c.created = b.created""",
    ),
)
def forecast_commercial(spark, folder):
    retail = Retail(spark, folder)
    daily = baseline.baseline_forecast(retail.series(BRAND), 120, [BRAND])
    filled = forecast.fill_commercial(
        daily.select(BRAND, DAY, "prediction"), retail.combined(BRAND), [BRAND]
    )
    return tidy(filled)


_HEURISTIC = (
    o.spends()
    + """, past AS (
  SELECT date AS created, totalRevenue AS y FROM spends WHERE date < DATE '2001-11-11'
  ORDER BY date DESC LIMIT 500),
asked AS (
  SELECT unnest(generate_series(TIMESTAMP '2001-10-28', TIMESTAMP '2001-11-10',
    INTERVAL 1 DAY))::DATE AS date),
anchored AS (
  SELECT date, CASE WHEN date > (SELECT max(created) FROM past)
    THEN (SELECT max(created) FROM past) + 1 ELSE date END AS anchor FROM asked),
estimates AS (
  SELECT date, avg(y) FILTER (created >= anchor - 7 AND created < anchor) AS trailing_mean_7,
    quantile_cont(y, 0.5) FILTER (created >= anchor - 56 AND created < anchor
      AND isodow(created) = isodow(date)) AS same_weekday_median_8w
  FROM anchored, past GROUP BY date),
blended AS (
  SELECT *, coalesce(0.45::DOUBLE * trailing_mean_7 + 0.55::DOUBLE * same_weekday_median_8w,
    trailing_mean_7, same_weekday_median_8w) AS estimate FROM estimates)"""
)


@query(
    "heuristic_revenue",
    with_(
        _HEURISTIC,
        "SELECT date, "
        + ", ".join(
            f"round({c}, 4) + 0.0 AS {c}" for c in (*_COMPONENTS, "estimate")
        )
        + " FROM blended",
    ),
)
def heuristic_revenue(spark, folder):
    spends = Retail(spark, folder).ad_spends()
    return tidy(baseline.heuristic_revenue(spends, "2001-10-28", 14), 4)


@query(
    "heuristic_total",
    with_(
        _HEURISTIC,
        """SELECT round(sum(estimate), 2) AS predicted_total_sum,
  bool_and(estimate IS NOT NULL) AS all_days_estimated, count(*) AS days FROM blended""",
    ),
)
def heuristic_total(spark, folder):
    spends = Retail(spark, folder).ad_spends()
    return baseline.heuristic_total(baseline.heuristic_revenue(spends, "2001-10-28", 14))


def brand_errors(spark, folder):
    """Validation errors of the blend and of each of its components, per brand."""
    tested = baseline.baseline_backtest(Retail(spark, folder).series(BRAND), [BRAND])
    variants = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.col(c).alias("p"))
                for m, c in o.VARIANTS.items()
            ]
        )
    ).alias("v")
    long = tested.select(BRAND, "sample_idx", DAY, "y_true", variants)
    predictions = long.select(
        BRAND, "sample_idx", DAY, "y_true", F.col("v.p").alias("y_pred"), F.col("v.model")
    )
    return evaluate.error_rows(predictions, F.col("model"), [BRAND])


MODELS = tuple(o.VARIANTS)


@query(
    "error_rows",
    with_(
        o.errors(),
        f"""SELECT model, p_brand, sample_idx, {r6("y_true")}, {r6("y_pred")}, {r6("mape")}, created
FROM errs""",
    ),
)
def error_rows(spark, folder):
    return tidy(brand_errors(spark, folder))


_METRICS = f"metrics AS (SELECT model, {o.METRICS}, count(*) AS n FROM errs GROUP BY model)"
_METRIC_COLUMNS = ", ".join(r6(c) for c in ("mae", "rmse", "mape"))


@query(
    "metrics_by_model",
    with_(o.errors() + ",\n" + _METRICS, f"SELECT model, {_METRIC_COLUMNS}, n FROM metrics"),
)
def metrics_by_model(spark, folder):
    return tidy(evaluate.metrics_by_model(brand_errors(spark, folder)))


@query(
    "metrics_round_trip",
    with_(o.errors() + ",\n" + _METRICS, f"SELECT model, {_METRIC_COLUMNS} FROM metrics"),
)
def metrics_round_trip(spark, folder):
    """Metrics written as one JSON record and read back by the file's suffix."""
    path = f"{staged_path(spark, 'metrics')}/metrics.json"
    found = evaluate.metrics_by_model(brand_errors(spark, folder))
    files.write_record(files.metrics_json(found).select("payload"), path)
    payload = spark.read.json(path)
    return tidy(files.metrics_rows(payload))


@query(
    "metrics_by_brand",
    with_(
        o.errors(),
        f"""SELECT model, p_brand, {_METRIC_COLUMNS}, n
FROM (SELECT model, p_brand, {o.METRICS}, count(*) AS n FROM errs GROUP BY ALL)""",
    ),
)
def metrics_by_brand(spark, folder):
    return tidy(evaluate.metrics_by_model(brand_errors(spark, folder), ["model", BRAND]))


@query(
    "metrics_long",
    with_(o.errors() + ",\n" + _METRICS, f"SELECT model, {_METRIC_COLUMNS} FROM metrics"),
)
def metrics_long(spark, folder):
    scored = evaluate.metrics_by_model(brand_errors(spark, folder)).withColumn(
        "error", F.lit(None).cast("string")
    )
    failed = scored.agg(F.lit("sarima").alias("model"), F.lit("not available").alias("error"))
    payload = files.metrics_json(scored.unionByName(failed, allowMissingColumns=True))
    return tidy(files.metrics_rows(payload))


@query(
    "select_best_model",
    with_(
        o.errors() + ",\n" + _METRICS,
        f"""SELECT model AS model_name, 'mae' AS metric_name, {r6("mae", "metric_value")}
FROM metrics ORDER BY mae LIMIT 1""",
    ),
)
def select_best_model(spark, folder):
    metrics = evaluate.metrics_by_model(brand_errors(spark, folder))
    return tidy(evaluate.select_best(metrics, "mae", order=MODELS))


@query(
    "mape_pct",
    with_(
        o.errors(),
        f"""SELECT model, {r6("value")} FROM (
  SELECT model, mape * CASE WHEN max(abs(mape)) OVER (PARTITION BY model) <= 1.5 THEN 100
    ELSE 1 END AS value FROM errs)""",
    ),
)
def mape_pct(spark, folder):
    return tidy(evaluate.metric_values(brand_errors(spark, folder), "mape", models=MODELS))


_ABS = "vals AS (SELECT model, abs(y_true - y_pred) AS value FROM errs)"


@query(
    "error_histogram",
    with_(
        o.errors()
        + ",\n"
        + _ABS
        + """, ranges AS (SELECT model, min(value) AS lo, max(value) AS hi FROM vals GROUP BY model),
bins AS (
  SELECT model, least(floor((value - lo) * 60.0::DOUBLE / (hi - lo)), 59)::INT AS bin, count(*) AS n
  FROM vals JOIN ranges USING (model) GROUP BY ALL)""",
        f"""SELECT r.model, b.bin, {r6("lo + (hi - lo) / 60.0::DOUBLE * b.bin", "low")},
  {r6("lo + (hi - lo) / 60.0::DOUBLE * (b.bin + 1)", "high")}, coalesce(n, 0) AS n
FROM ranges r CROSS JOIN (SELECT unnest(range(60))::INT AS bin) b
LEFT JOIN bins ON bins.model = r.model AND bins.bin = b.bin""",
    ),
)
def error_histogram(spark, folder):
    values = evaluate.error_values(brand_errors(spark, folder), "abs_error")
    return tidy(evaluate.histogram(values, models=MODELS))


@query(
    "squared_error_histogram",
    with_(
        o.errors()
        + """, vals AS (SELECT model, (y_true - y_pred) * (y_true - y_pred) AS value FROM errs),
bins AS (
  SELECT model, least(floor(value * 60.0::DOUBLE / 9.6e6), 59)::INT AS bin, count(*) AS n
  FROM vals WHERE value <= 9.6e6 GROUP BY ALL)""",
        f"""SELECT m.model, b.bin, {r6("160000.0::DOUBLE * b.bin", "low")},
  {r6("160000.0::DOUBLE * (b.bin + 1)", "high")}, coalesce(n, 0) AS n
FROM (SELECT DISTINCT model FROM vals) m CROSS JOIN (SELECT unnest(range(60))::INT AS bin) b
LEFT JOIN bins ON bins.model = m.model AND bins.bin = b.bin""",
    ),
)
def squared_error_histogram(spark, folder):
    values = evaluate.error_values(brand_errors(spark, folder), "rmse")
    return tidy(evaluate.histogram(values, models=MODELS, limits=evaluate.shared_range("rmse")))


@query(
    "error_kde",
    with_(
        o.errors()
        + ",\n"
        + _ABS
        + """, stats AS (
  SELECT model, min(value) AS lo, max(value) AS hi,
    pow(count(*), -0.2::DOUBLE) * stddev_samp(value) AS h FROM vals GROUP BY model)""",
        f"""SELECT model, point, {r6("max(lo + (hi - lo) / 199 * point)", "x")},
  {r6("sum(exp(-0.5 * pow((lo + (hi - lo) / 199 * point - value) / h, 2)) * (hi - lo) / 60 "
      "/ (h * sqrt(2 * pi())))", "y")}
FROM vals JOIN stats USING (model), (SELECT unnest(range(200))::INT AS point) GROUP BY ALL""",
    ),
)
def error_kde(spark, folder):
    values = evaluate.error_values(brand_errors(spark, folder), "abs_error")
    return tidy(evaluate.density(values, models=MODELS))


@query(
    "true_vs_pred",
    with_(
        o.errors(),
        f"""SELECT p_brand, (created - min(created) OVER (PARTITION BY p_brand))::DOUBLE AS x,
  {r6("y_true")}, {r6("y_pred")}, {r6("avg(mape * 100) OVER (PARTITION BY p_brand)", "mape_pct")}
FROM errs WHERE model = 'baseline_tm7_sw8_blend'""",
    ),
)
def true_vs_pred(spark, folder):
    errors = brand_errors(spark, folder)
    return tidy(evaluate.true_vs_pred(errors, "Baseline_TM7_SW8_Blend", keys=[BRAND]))


@query(
    "mean_y_true",
    with_(o.errors(), f'SELECT {r6("avg(y_true)", "mean_y_true")}, count(y_true) AS n FROM errs'),
)
def mean_y_true(spark, folder):
    return tidy(evaluate.mean_of(brand_errors(spark, folder)))


# The candidates of the baseline grid.
BASELINE_GRID = {
    "baseline_trailing_days": [7, 14],
    "baseline_weekday_weeks": [4, 8, 12],
    "baseline_trailing_weight": [0.45],
    "baseline_weekday_weight": [0.55],
}


_ALPHAS = (0.1, 1.0, 5.0, 10.0, 100000.0)


def _grid_sql():
    runs = [(d, w) for d in (7, 14) for w in (4, 8, 12)]
    frame = "RANGE BETWEEN INTERVAL {} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"
    back = "(PARTITION BY p_brand, split ORDER BY created ROWS UNBOUNDED PRECEDING)"
    ahead = (
        "(PARTITION BY p_brand, split ORDER BY created "
        "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )
    known = "CASE WHEN y IS NOT NULL THEN created END"
    candidates = ",\n    ".join(
        [f"avg(y) {o.over(BRAND, 'created', frame.format(d))} AS t{d}" for d in (7, 14)]
        + [
            f"quantile_cont(y, 0.5) {o.over('p_brand, isodow(created)', 'created', frame.format(7 * w))} AS w{w}"
            for w in (4, 8, 12)
        ]
    )
    rows = "\nUNION ALL ".join(
        f"""SELECT p_brand, {i} AS run_id, {d} AS trailing_days, {w} AS weekday_weeks, y_true,
  coalesce(0.45::DOUBLE * t{d} + 0.55::DOUBLE * w{w}, t{d}, w{w}) AS y_pred FROM placed
WHERE split = 'val'"""
        for i, (d, w) in enumerate(runs)
    )
    return with_(
        o.series(BRAND)
        + f""", days AS (
  SELECT p_brand, unnest(generate_series(min(created)::TIMESTAMP, max(created)::TIMESTAMP,
    INTERVAL 1 DAY))::DATE AS created FROM series GROUP BY p_brand),
parts AS (
  SELECT *, CASE WHEN row_number() {o.over(BRAND, "created")} - 1
    < trunc(count(*) {o.over(BRAND)} * {o.TRAIN}) THEN 'train' ELSE 'val' END AS split
  FROM days LEFT JOIN series USING (p_brand, created)),
edges AS (
  SELECT *, last_value({known} IGNORE NULLS) OVER {back} AS d0,
    last_value(y IGNORE NULLS) OVER {back} AS y0,
    first_value({known} IGNORE NULLS) OVER {ahead} AS d1,
    first_value(y IGNORE NULLS) OVER {ahead} AS y1
  FROM parts),
placed AS (
  SELECT *, coalesce(y, y0 + (y1 - y0) * (created - d0) / (d1 - d0), y0, y1) AS y_true,
    {candidates}
  FROM edges),
runs AS ({rows})""",
        f"""SELECT p_brand, run_id, trailing_days, weekday_weeks, 0.45::DOUBLE AS trailing_weight,
  0.55::DOUBLE AS weekday_weight, {r6("avg(abs(y_true - y_pred))", "mae")},
  {r6("sqrt(avg((y_true - y_pred) * (y_true - y_pred)))", "rmse")},
  {r6("avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-8))", "mape")}
FROM runs GROUP BY ALL""",
    )


@query("baseline_grid", _grid_sql())
def baseline_grid(spark, folder):
    series = Retail(spark, folder).series(BRAND)
    grid = models.expand_grid(BASELINE_GRID)
    return tidy(baseline.baseline_grid(series, grid, [BRAND], ratio=RATIO))


_SHIFTED_SPEND = """spend_overrides AS (
  SELECT p_brand, created + 14 AS created, adSpend AS value FROM trimmed
  WHERE isodow(created) <= 5 AND adSpend IS NOT NULL),
event_overrides AS (
  SELECT p_brand, created + 14 AS created, 0.3 + 0.1 * (isodow(created) - 1) AS value FROM trimmed),
last_day AS (
  SELECT p_brand, max(created) AS last, arg_max(coalesce(adSpend, 0.0), created) AS last_spend
  FROM trimmed GROUP BY p_brand)"""


def _shifted_overrides(trimmed):
    """Overrides for the two weeks after a panel's end, taken from its last two weeks."""
    last = trimmed.groupBy(BRAND).agg(F.max(DAY).alias("_last"))
    trimmed = trimmed.join(last, BRAND).filter(F.col(DAY) > F.date_sub("_last", 14))
    day = F.date_add(DAY, 14).alias(DAY)
    spend = trimmed.filter((F.weekday(DAY) < 5) & F.col("adSpend").isNotNull()).select(
        BRAND, day, F.col("adSpend").alias("value")
    )
    events = trimmed.select(BRAND, day, (F.lit(0.3) + F.lit(0.1) * F.weekday(DAY)).alias("value"))
    return spend, events


@query(
    "future_covariates",
    with_(
        o.trimmed(BRAND)
        + ",\n"
        + _SHIFTED_SPEND
        + f""", horizon AS (
  SELECT *, unnest(generate_series((last + 1)::TIMESTAMP, (last + 14)::TIMESTAMP,
    INTERVAL 1 DAY))::DATE AS created FROM last_day),
flags AS (
  SELECT h.p_brand, h.created, last_spend, s.value AS spend,
    CAST(coalesce(e.value, 0) >= 0.5 AS INT)::DOUBLE AS event_start
  FROM horizon h LEFT JOIN spend_overrides s USING (p_brand, created)
  LEFT JOIN event_overrides e USING (p_brand, created))""",
        f"""SELECT p_brand, created, coalesce(last_value(spend IGNORE NULLS) {o.over(
            BRAND, "created", "ROWS UNBOUNDED PRECEDING")}, last_spend) AS adSpend, event_start,
  coalesce(lead(event_start) {o.over(BRAND, "created")}, 0.0) AS event_start_next_1 FROM flags""",
    ),
)
def future_covariates(spark, folder):
    trimmed = calendar.trim_last_day(Retail(spark, folder).combined(BRAND), [BRAND])
    spend, events = _shifted_overrides(trimmed)
    last = trimmed.groupBy(BRAND).agg(
        F.max(DAY).alias(DAY),
        F.max_by(F.coalesce("adSpend", F.lit(0.0)), DAY).alias("adSpend"),
    )
    return overrides.future_covariates(
        last, HORIZON, keys=[BRAND], ad_spend=spend, events=events
    )


def _future_panel_sql():
    line = o.over(BRAND, "created")
    carried = [c for c in o.PANEL if c not in ("created_weekday", "created_month")]
    cycles = {
        "created_weekday_sin": "sin(2 * pi() * (isodow(created) - 1) / 7)",
        "created_weekday_cos": "cos(2 * pi() * (isodow(created) - 1) / 7)",
        "created_month_sin": "sin(2 * pi() * month(created) / 12)",
        "created_month_cos": "cos(2 * pi() * month(created) / 12)",
    }
    lagged = ", ".join(
        f"coalesce(lag({c}, {k}) {line}, 0.0) AS {c}_lag_{k}"
        for k in (1, 7, 30)
        for c in ("adSpend", "orders")
    )
    shown = ", ".join(r6(c) for c in o.FEATURES)
    return with_(
        o.panel(BRAND)
        + f""", tails AS (
  SELECT *, created AS last FROM panel QUALIFY row_number() {o.over(BRAND, "created DESC")} = 1),
ahead AS (
  SELECT p_brand, last, unnest(generate_series((last + 1)::TIMESTAMP, (last + 7)::TIMESTAMP,
    INTERVAL 1 DAY))::DATE AS created, {", ".join(carried)},
    CASE WHEN totalRevenue <> 0 THEN 0.0 ELSE revenue_growth END AS revenue_growth,
    CASE WHEN adSpend <> 0 THEN 0.0 ELSE investment_growth END AS investment_growth
  FROM tails),
extended AS (
  SELECT p_brand, NULL::DATE AS last, created, {", ".join(carried)}, revenue_growth,
    investment_growth FROM panel
  UNION ALL SELECT * FROM ahead),
rows AS (
  SELECT *, {lagged},
    (isodow(created) - 1)::DOUBLE AS created_weekday, month(created)::DOUBLE AS created_month,
    {", ".join(f"{v} AS {k}" for k, v in cycles.items())}, 0.0 AS event_start_next_1
  FROM extended)""",
        f"""SELECT p_brand, created, last AS series_last_date, {shown}
FROM rows WHERE last IS NOT NULL""",
    )


@query("future_panel", _future_panel_sql())
def future_panel(spark, folder):
    panel = Retail(spark, folder).panel(BRAND)
    return tidy(forecast.future_panel(panel, 7, [BRAND]))


def _global_windows(spark, folder):
    panel = models.stored_panel(Retail(spark, folder).panel())
    return panel, windows.training_vectors(panel, list(o.FEATURES), ratio=RATIO)


def _window_model_errors(spark, folder, name, options=None):
    _, framed = _global_windows(spark, folder)
    train, validation = models.prepared_windows(framed, RATIO)
    fitted = models.fit_window_model(name, train, options)
    return models.validation_errors(name, fitted, validation)


@query("lr_backtest")
def lr_backtest(spark, folder):
    return _window_model_errors(spark, folder, "linear_regression")


@query("ridge_backtest")
def ridge_backtest(spark, folder):
    return _window_model_errors(spark, folder, "ridge")


@query("rf_backtest")
def rf_backtest(spark, folder):
    return _window_model_errors(spark, folder, "random_forest")


@query("gbt_backtest")
def gbt_backtest(spark, folder):
    return _window_model_errors(spark, folder, "xgboost")


@query("model_comparison")
def model_comparison(spark, folder):
    panel, framed = _global_windows(spark, folder)
    chosen = (*models.WINDOW_MODELS, *models.SERIES_MODELS, "sarima")
    return models.compare_models(framed, panel, models=chosen).metrics


@query("grid_best")
def grid_best(spark, folder):
    _, framed = _global_windows(spark, folder)
    results = models.grid_search("ridge", {"ridge_alpha": [0.1, 1.0, 5, 10.0]}, windows=framed)
    return models.best_run(results).drop("generated_at")


@query("feature_importance")
def feature_importance(spark, folder):
    _, framed = _global_windows(spark, folder)
    train, _ = models.prepared_windows(framed, RATIO)
    fitted = models.fit_window_model("ridge", train)
    return importance.feature_importance(spark, fitted, o.FEATURES)


def _brand_ridge(spark, folder):
    """Panel of all brands, and one ridge over the windows of all of them that knows the brand."""
    panel = models.stored_panel(Retail(spark, folder).panel(BRAND))
    framed = windows.training_vectors(panel, list(o.FEATURES), ratio=RATIO, keys=[BRAND])
    train, _ = models.prepared_windows(framed, RATIO, [BRAND])
    return panel, models.fit_window_model("ridge", train, series=[BRAND])


@query("recursive_forecast")
def recursive_forecast(spark, folder):
    panel, fitted = _brand_ridge(spark, folder)
    spend, events = _shifted_overrides(panel)
    winner = {"model_name": "ridge", "metric_name": "mae", "metric_value": None}
    return flows.forecast_winner(
        winner, fitted, panel, HORIZON, [BRAND], ad_spend=spend, events=events
    )


_GAP = 3  # days after the panel's end that are carried before the first prediction


@query(
    "recursive_forecast_two_inputs",
    with_(
        o.panel()
        + f""", placed AS (
  SELECT *, row_number() {o.over(None, "created")} - 1 AS i, count(*) {o.over(None)} AS n
  FROM (SELECT created, orders::DOUBLE AS y, lag(orders) {o.over(None, "created")}::DOUBLE AS p,
    lag(adSpend) {o.over(None, "created")}::DOUBLE AS q FROM panel) WHERE p IS NOT NULL),
sums AS (
  SELECT avg(y) AS my, avg(p) AS mp, avg(q) AS mq, var_pop(p) AS pp, var_pop(q) AS qq, covar_pop(p, q) AS pq,
    covar_pop(p, y) AS py, covar_pop(q, y) AS qy FROM placed WHERE i < trunc(n * {o.TRAIN})),
line AS (
  SELECT (py * qq - qy * pq) / (pp * qq - pq * pq) AS wp, (qy * pp - py * pq) / (pp * qq - pq * pq) AS wq, my, mp, mq FROM sums),
last AS (SELECT created AS d, orders::DOUBLE AS y, adSpend::DOUBLE AS q FROM panel ORDER BY created DESC LIMIT 1),
ahead AS (
  SELECT 0 AS k, y FROM last
  UNION ALL
  SELECT k + 1, CASE WHEN k < {_GAP} THEN ahead.y ELSE my + wp * (ahead.y - mp) + wq * (q - mq) END
  FROM ahead, line, (SELECT q FROM last) WHERE k < {_GAP + HORIZON})""",
        f"""SELECT (d + k)::DATE AS created, d AS series_last_date, {r6("ahead.y", "prediction")}
FROM ahead, last WHERE k > {_GAP}""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def recursive_forecast_two_inputs(spark, folder):
    """A linear model of two inputs fed back day by day, after a gap of carried days."""
    panel = models.stored_panel(Retail(spark, folder).panel())
    vectors = windows.training_vectors(panel, ["orders", "adSpend"], window=1, ratio=RATIO)
    fitted = models.fit_window_model("linear_regression", models.prepared_windows(vectors, RATIO)[0])
    first = panel.agg(F.date_add(F.max(DAY), _GAP + 1).cast("string")).first()[0]
    out = forecast.recursive_forecast(panel, fitted, HORIZON, first=first)
    return tidy(out.select(DAY, "series_last_date", "prediction"))


@query("forest_importance")
def forest_importance(spark, folder):
    """Importance of a forest of twenty trees by input name."""
    _, framed = _global_windows(spark, folder)
    train, _ = models.prepared_windows(framed, RATIO)
    fitted = models.fit_window_model("random_forest", train, {"random_forest_n_estimators": 20})
    return importance.feature_importance(spark, fitted, o.FEATURES)


@query("forest_forecast")
def forest_forecast(spark, folder):
    """Recursive forecast of a forest, first predicting three days after the panel's end."""
    panel, framed = _global_windows(spark, folder)
    train, _ = models.prepared_windows(framed, RATIO)
    fitted = models.fit_window_model("random_forest", train)
    first = panel.agg(F.date_add(F.max(DAY), 4).cast("string")).first()[0]
    winner = {"model_name": "random_forest", "metric_name": "mae", "metric_value": None}
    return flows.forecast_winner(winner, fitted, panel, HORIZON, first=first)


def _one_input(spark, folder, name):
    """Errors of a window model that sees yesterday's orders only."""
    panel = models.stored_panel(Retail(spark, folder).panel())
    train, validation = models.prepared_windows(
        windows.training_vectors(panel, ["orders"], window=1, ratio=RATIO), RATIO
    )
    fitted = models.fit_window_model(name, train)
    found = models.validation_errors(name, fitted, validation)
    return tidy(found.select(DAY, "y_true", "y_pred"))


def _one_input_sql(penalty):
    """Least squares in closed form, the penalty on the slope alone."""
    return with_(
        o.panel()
        + f""", framed AS (
  SELECT created, orders AS y, lag(orders) {o.over(None, "created")} AS x FROM panel),
placed AS (
  SELECT *, row_number() {o.over(None, "created")} - 1 AS i, count(*) {o.over(None)} AS n
  FROM framed WHERE x IS NOT NULL),
sums AS (
  SELECT avg(x) AS mx, avg(y) AS my, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx
  FROM placed WHERE i < trunc(n * {o.TRAIN})),
line AS (SELECT mx, my, sxy / (sxx + {penalty}) AS slope FROM sums)""",
        f"""SELECT created, {r6("y", "y_true")}, {r6("my + slope * (x - mx)", "y_pred")}
FROM placed, line WHERE i >= trunc(n * {o.TRAIN})""",
    )


@query("lr_backtest_one_input", _one_input_sql("0"))
def lr_backtest_one_input(spark, folder):
    return _one_input(spark, folder, "linear_regression")


@query("ridge_backtest_one_input", _one_input_sql("5.0"))
def ridge_backtest_one_input(spark, folder):
    return _one_input(spark, folder, "ridge")


# A day without orders makes a proportion of about 1e8, which has fewer decimal places in a double.
_SCORES = f"{r6('mae')}, {r6('rmse')}, round(mape, 3) + 0.0 AS mape"


def _scores(metrics):
    return tidy(metrics.withColumn("mape", F.round("mape", 3)))


def _compared_sql():
    """Metrics of both lines through yesterday's orders and of the blend; the unknown model's error."""
    blend = o.backtest()[len(o.series()) + 2 :]
    lines = "\n  UNION ALL ".join(
        f"""SELECT '{name}' AS model, y AS y_true, my + sxy / (sxx + {penalty}) * (x - mx) AS y_pred
  FROM placed, sums WHERE i >= trunc(n * {o.TRAIN})"""
        for name, penalty in (("linear_regression", 0), ("ridge", 5.0))
    )
    return with_(
        o.panel()
        + f""", series AS (SELECT created, orders::DOUBLE AS y FROM panel),
{blend},
placed AS (
  SELECT *, row_number() {o.over(None, "created")} - 1 AS i, count(*) {o.over(None)} AS n
  FROM (SELECT created, y, lag(y) {o.over(None, "created")} AS x FROM series) WHERE x IS NOT NULL),
sums AS (
  SELECT avg(x) AS mx, avg(y) AS my, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx
  FROM placed WHERE i < trunc(n * {o.TRAIN})),
tried AS ({lines}
  UNION ALL SELECT 'baseline_tm7_sw8_blend', y_true, y_pred FROM backtest),
errs AS (SELECT *, abs(y_true - y_pred) / greatest(abs(y_true), 1e-8) AS mape FROM tried),
metrics AS (SELECT model, {o.METRICS} FROM errs GROUP BY model)""",
        f"""SELECT model, {_SCORES}, CAST(NULL AS VARCHAR) AS error FROM metrics
UNION ALL SELECT 'sarima', NULL, NULL, NULL, 'model ''sarima'' is not available'""",
    )


@query("model_comparison_one_input", _compared_sql())
def model_comparison_one_input(spark, folder):
    """The comparison run on yesterday's orders alone, for models that SQL can state."""
    panel = models.stored_panel(Retail(spark, folder).panel())
    vectors = windows.training_vectors(panel, ["orders"], window=1, ratio=RATIO)
    chosen = ("linear_regression", "ridge", "sarima", "baseline_tm7_sw8_blend")
    return _scores(models.compare_models(vectors, panel, models=chosen).metrics)


def _grid_sql():
    alphas = ", ".join(f"({i}, {a})" for i, a in enumerate(_ALPHAS))
    return with_(
        o.panel()
        + f""", placed AS (
  SELECT *, row_number() {o.over(None, "created")} - 1 AS i, count(*) {o.over(None)} AS n
  FROM (SELECT created, orders::DOUBLE AS y, lag(orders) {o.over(None, "created")} AS x FROM panel) WHERE x IS NOT NULL),
sums AS (
  SELECT avg(x) AS mx, avg(y) AS my, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx
  FROM placed WHERE i < trunc(n * {o.TRAIN})),
runs(run_id, alpha) AS (VALUES {alphas}),
errs AS (
  SELECT run_id, y AS y_true, my + sxy / (sxx + alpha) * (x - mx) AS y_pred FROM placed, sums, runs
  WHERE i >= trunc(n * {o.TRAIN})),
scored AS (SELECT *, abs(y_true - y_pred) / greatest(abs(y_true), 1e-8) AS mape FROM errs),
metrics AS (SELECT run_id, {o.METRICS} FROM scored GROUP BY run_id)""",
        f"SELECT CAST(run_id AS INT) AS run_id, {_SCORES} FROM metrics",
    )


@query("ridge_grid_one_input", _grid_sql())
def ridge_grid_one_input(spark, folder):
    """All candidates of a ridge grid from one pass, on yesterday's orders."""
    panel = models.stored_panel(Retail(spark, folder).panel())
    vectors = windows.training_vectors(panel, ["orders"], window=1, ratio=RATIO)
    found = models.grid_search("ridge", {"ridge_alpha": list(_ALPHAS)}, windows=vectors)
    return _scores(found.select("run_id", "mae", "rmse", "mape"))


@query(
    "ridge_optimality",
    with_(
        o.panel(),
        f"""SELECT CAST(i AS INT) AS coefficient, CAST(0 AS DOUBLE) AS residual
FROM generate_series(0, 28 * {len(o.FEATURES)} - 1) g(i)""",
    ),
)
def ridge_optimality(spark, folder):
    """Slope of the penalised loss at the fitted ridge, by coefficient, relative to its parts."""
    _, framed = _global_windows(spark, folder)
    train, _ = models.prepared_windows(framed, RATIO)
    fitted = models.fit_window_model("ridge", train)
    weights = F.array(*[F.lit(float(w)) for w in fitted.coefficients])
    error = F.col("prediction") - F.col("y")
    inputs = fitted.transform(train).select(
        F.posexplode(vector_to_array("features")).alias("coefficient", "x"), error.alias("e")
    )
    slope = F.sum(F.col("e") * F.col("x")) + 5.0 * F.get(weights, F.col("coefficient"))
    size = F.sum(F.abs(F.col("e") * F.col("x"))) + 1.0
    parts = inputs.groupBy("coefficient").agg(F.round(slope / size, 4).alias("residual"))
    return parts.withColumn("residual", F.col("residual") + F.lit(0.0))


@query(
    "promoted_forecast",
    with_(
        _forecast_sql(None),
        "SELECT created, series_last_date, round(prediction, 2) + 0.0 AS prediction, "
        "'baseline_tm7_sw8_blend' AS model_name FROM blended",
    ),
)
def promoted_forecast(spark, folder):
    """Train, promote, load and forecast from the stored winner alone."""
    series = Retail(spark, folder).series()
    panel = models.stored_panel(series.withColumnRenamed("y", "orders"))
    path = staged_path(spark, "winner")
    compared = models.Comparison(
        models.compare_models(
            windows.training_vectors(panel, ["orders"], ratio=RATIO),
            panel,
            models=("baseline_tm7_sw8_blend",),
        ).metrics,
        None,
        {"baseline_tm7_sw8_blend": baseline.Blend()},
    )
    models.promote(compared, "orders", path)
    out = flows.forecast_stored(path, panel, HORIZON)
    return out.select(DAY, "series_last_date", (F.col("prediction") + F.lit(0.0)).alias("prediction"), "model_name")


@query(
    "baseline_forecast_from",
    with_(
        _forecast_sql(BRAND, HORIZON + 90),
        f"""SELECT p_brand, created, series_last_date, {', '.join(r6(c) for c in (*_COMPONENTS, "prediction"))}
FROM blended WHERE created >= (SELECT max(last) + 4 FROM lasts)
  AND created < (SELECT max(last) + {4 + HORIZON} FROM lasts)""",
    ),
)
def baseline_forecast_from(spark, folder):
    """A forecast whose first day lies three days beyond the end of the series."""
    series = Retail(spark, folder).series(BRAND)
    first = series.agg(F.date_add(F.max(DAY), 4).cast("string")).first()[0]
    return tidy(baseline.baseline_forecast(series, HORIZON, [BRAND], first=first))


def _smoothed_sql():
    """Every grid point as a recursion over the days, then the forecast of the one with the least error."""
    points = ", ".join(f"({i}, {a}, {b}, {g})" for i, (a, b, g) in enumerate(smoothing.GRID))
    expected = "(fold.level + fold.trend)"
    seen = "(y[fold.i + 1] - {0})"
    s = "season[fold.i % 7 + 1]"
    raised = f"(a * {seen.format(s)} + (1 - a) * {expected})"
    return with_(
        o.panel()
        + f""", grid(place, a, b, g) AS (VALUES {points}),
whole AS (SELECT list(orders::DOUBLE ORDER BY created) AS y, max(created) AS last FROM panel),
weeks AS (SELECT y, last, list_avg(y[1:7]) AS one, list_avg(y[8:14]) AS two FROM whole),
line AS (SELECT y, last, (two - one) / 7 AS slope, one - (two - one) / 7 * 4 AS start FROM weeks),
fold AS (
  SELECT place, a, b, g, 0 AS i, start AS level, slope AS trend,
    list_transform(range(1, 8), lambda k: y[k] - (start + slope * k)) AS season, 0::DOUBLE AS sse FROM line, grid
  UNION ALL
  SELECT place, a, b, g, fold.i + 1, {raised}, b * ({raised} - fold.level) + (1 - b) * fold.trend,
    list_transform(season, lambda v, k: CASE WHEN k = fold.i % 7 + 1
      THEN g * {seen.format(expected)} + (1 - g) * v ELSE v END),
    fold.sse + power(y[fold.i + 1] - {expected} - {s}, 2)
  FROM fold, line WHERE fold.i < len(y)),
best AS (SELECT fold.*, last FROM fold, line WHERE fold.i = len(y) ORDER BY sse, place LIMIT 1),
ahead AS (SELECT unnest(range(1, {HORIZON} + 1)) AS k)""",
        f"""SELECT (last + k::INT)::DATE AS created, {r6("level + k * trend + season[(i + k - 1) % 7 + 1]", "prediction")},
  a::DOUBLE AS alpha, b::DOUBLE AS beta, g::DOUBLE AS gamma, {r6("sse")} FROM best, ahead""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@query("holt_winters_grid", _smoothed_sql())
def holt_winters_grid(spark, folder):
    """Forecast of the panel's orders by the best point of the grid, without refinement."""
    series = Retail(spark, folder).panel().select(DAY, F.col("orders").cast("double").alias("y"))
    return tidy(smoothing.smoothing_forecast(series, HORIZON, rounds=0))


@query("holt_winters_forecast")
def holt_winters_forecast(spark, folder):
    series = calendar.complete_calendar(Retail(spark, folder).series(BRAND), [BRAND])
    return smoothing.smoothing_forecast(series, HORIZON, [BRAND])


@query(
    "importance_share",
    with_(
        o.LINES + ", units AS (SELECT p_type, p_brand, sum(quantity) AS units FROM lines GROUP BY ALL)",
        f"""SELECT p_type, p_brand, units,
  {r6("100 * units / sum(units) OVER (PARTITION BY p_type)", "units_pct")} FROM units""",
    ),
)
def importance_share(spark, folder):
    lines = Retail(spark, folder).lines_by("p_type", BRAND)
    units = lines.groupBy("p_type", BRAND).agg(F.sum("quantity").alias("units"))
    return tidy(importance.share_within(units, "units", ["p_type"]))


@query(
    "importance_topn",
    with_(
        o.LINES + ", units AS (SELECT productId, sum(quantity) AS units FROM lines GROUP BY ALL)",
        f"""SELECT productId, units, {r6("100 * units / sum(units) OVER ()", "units_pct")}
FROM units ORDER BY units DESC, productId LIMIT 25""",
    ),
)
def importance_topn(spark, folder):
    units = (
        Retail(spark, folder)
        .order_lines()
        .groupBy("productId")
        .agg(F.sum("quantity").alias("units"))
    )
    shared = importance.share_within(units, "units")
    return tidy(importance.top_n(shared, "units", 25, ["productId"]))


@query(
    "closed_day_counts",
    """SELECT event_type, CAST(ts AS DATE) AS created, count(*) AS orders FROM events
WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 HOUR AS DATE) FROM events) GROUP BY ALL""",
)
def closed_day_counts(spark, folder):
    source = spark.read.parquet(f"{folder}/events.parquet")
    stream = (
        spark.readStream.schema(source.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )
    counts = closed_days.closed_day_counts(stream, "ts", ["event_type"])
    run = staged_path(spark, "closed-days")
    closed_days.write_closed_days(counts, f"{run}/out", f"{run}/state").awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{run}/out")

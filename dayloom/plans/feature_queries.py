"""Queries: calendars, gap filling, imputation, features, splits, windows, model frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.operators import calendar, covariates, evaluate, features, split, windows
from dayloom.operators.daily import DAY
from dayloom.plans import oracle as o
from dayloom.plans.catalog import query, tidy
from dayloom.plans.oracle import BRAND, r6, with_
from dayloom.session import staged_path
from dayloom.sources import files
from dayloom.sources.retail import Retail

RATIO = 0.2
_PANEL_DAY = ("created", *o.PANEL)


@query(
    "target_series",
    with_(
        o.series(BRAND)
        + """, days AS (
  SELECT p_brand, unnest(generate_series(min(created)::TIMESTAMP, max(created)::TIMESTAMP,
    INTERVAL 1 DAY))::DATE AS created FROM series GROUP BY p_brand)""",
        "SELECT * FROM days LEFT JOIN series USING (p_brand, created)",
    ),
)
def target_series(spark, folder):
    return calendar.target_series(Retail(spark, folder).series(BRAND), "y", [BRAND])


@query(
    "complete_calendar",
    with_(o.completed(BRAND), f"SELECT p_brand, {', '.join(_PANEL_DAY)} FROM completed"),
)
def complete_calendar(spark, folder):
    trimmed = calendar.trim_last_day(Retail(spark, folder).combined(BRAND), [BRAND])
    return calendar.complete_calendar(trimmed, [BRAND])


def _imputed_sql(stat: str) -> str:
    columns = ("orders", "adSpend", "totalRevenue")
    parts = ", ".join(
        r6(f"coalesce({c}::DOUBLE, {stat.format(c)} {o.over(BRAND)}, 0.0)", c)
        + f", CAST({c} IS NULL AS INT) AS {c}_was_missing"
        for c in columns
    )
    return with_(o.completed(BRAND), f"SELECT p_brand, created, {parts} FROM completed")


def _imputed(spark, folder, strategy):
    columns = ["orders", "adSpend", "totalRevenue"]
    rows = complete_calendar(spark, folder).select(BRAND, DAY, *columns)
    return tidy(
        features.impute(rows, columns, [BRAND], strategy=strategy, indicators=True)
    )


@query("impute_median", _imputed_sql("quantile_cont({}::DOUBLE, 0.5)"))
def impute_median(spark, folder):
    return _imputed(spark, folder, "median")


@query("impute_mean", _imputed_sql("avg({}::DOUBLE)"))
def impute_mean(spark, folder):
    return _imputed(spark, folder, "mean")


@query(
    "cyclical_features",
    with_(
        o.series(BRAND),
        f"""SELECT p_brand, created,
  {r6("sin(2 * pi() * (isodow(created) - 1) / 7)", "created_weekday_sin")},
  {r6("cos(2 * pi() * (isodow(created) - 1) / 7)", "created_weekday_cos")},
  {r6("sin(2 * pi() * month(created) / 12)", "created_month_sin")},
  {r6("cos(2 * pi() * month(created) / 12)", "created_month_cos")}
FROM series""",
    ),
)
def cyclical_features(spark, folder):
    return tidy(features.add_cyclical(Retail(spark, folder).series(BRAND)).drop("y"))


_LAG_NAMES = [f"{c}_lag_{k}" for k in (1, 7, 30) for c in ("adSpend", "orders")]


@query(
    "lag_features",
    with_(
        o.trimmed(BRAND),
        "SELECT p_brand, created, "
        + ", ".join(
            f"lag({n.split('_lag_')[0]}, {n.split('_lag_')[1]}) {o.over(BRAND, 'created')} AS {n}"
            for n in _LAG_NAMES
        )
        + f""", event_start::DOUBLE AS event_start,
  coalesce(lead(event_start) {o.over(BRAND, "created")}, 0)::DOUBLE AS event_start_next_1
FROM trimmed""",
    ),
)
def lag_features(spark, folder):
    rows = trimmed_by_brand(spark, folder).select(BRAND, DAY, "orders", "adSpend", "event_start")
    lagged = features.add_lags(rows, (30, 1, 7, 7, 0), [BRAND])
    return features.add_event_lead(lagged, [BRAND]).drop("orders", "adSpend")


def trimmed_by_brand(spark, folder):
    return calendar.trim_last_day(Retail(spark, folder).combined(BRAND), [BRAND])


def _growth_sql(column, name):
    before = f"lag({column}) {o.over(BRAND, 'created')}"
    return r6(f"({column} - {before}) / nullif({before}, 0)", name)


@query(
    "growth_features",
    with_(
        o.trimmed(BRAND),
        f"""SELECT p_brand, created, {_growth_sql("totalRevenue", "revenue_growth")},
  {_growth_sql("adSpend", "investment_growth")} FROM trimmed""",
    ),
)
def growth_features(spark, folder):
    rows = trimmed_by_brand(spark, folder).select(BRAND, DAY, "totalRevenue", "adSpend")
    return tidy(features.add_growth(rows, [BRAND]).drop("totalRevenue", "adSpend"))


def _pct(key):
    before = f"lag(y) {o.over(key, 'created')}"
    return (
        o.series(key)
        + f""", pct AS (
  SELECT * FROM (SELECT *, 100 * (y - {before}) / nullif({before}, 0) AS y_pct_change FROM series)
  WHERE y_pct_change IS NOT NULL)"""
    )


@query(
    "orders_pct_change",
    with_(_pct(BRAND), f"SELECT p_brand, created, y, {r6('y_pct_change')} FROM pct"),
)
def orders_pct_change(spark, folder):
    return tidy(features.pct_change(Retail(spark, folder).series(BRAND), "y", [BRAND]))


_MA = "avg(y_pct_change) {} AS y_pct_change_ma7"


@query(
    "orders_pct_change_ma7",
    with_(
        _pct(BRAND)
        + f""", smooth AS (SELECT *, {_MA.format(
            o.over(BRAND, "created", "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"))} FROM pct)""",
        f"SELECT p_brand, created, y, {r6('y_pct_change')}, {r6('y_pct_change_ma7')} FROM smooth",
    ),
)
def orders_pct_change_ma7(spark, folder):
    return tidy(features.pct_change_smoothed(Retail(spark, folder).series(BRAND), "y", [BRAND]))


@query(
    "pct_change_summary",
    with_(
        _pct(BRAND)
        + f""", smooth AS (SELECT *, {_MA.format(
            o.over(BRAND, "created", "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"))} FROM pct)""",
        """SELECT count(*) AS n_points, -100.0::DOUBLE AS y_low, 100.0::DOUBLE AS y_high,
  count(*) FILTER (y_pct_change < -100 OR y_pct_change > 100) AS n_clipped FROM smooth
UNION ALL SELECT count(*), -60.0::DOUBLE, 200.0::DOUBLE,
  count(*) FILTER (y_pct_change_ma7 < -60 OR y_pct_change_ma7 > 200) FROM smooth""",
    ),
)
def pct_change_summary(spark, folder):
    smooth = features.pct_change_smoothed(Retail(spark, folder).series(BRAND), "y", [BRAND])
    return evaluate.clipped_days(smooth, "y_pct_change").unionByName(
        evaluate.clipped_days(smooth, "y_pct_change_ma7", evaluate.SMOOTHED_PCT_LIMITS)
    )


_DENSE = """, dense AS (
  SELECT d.p_brand, d.created, y FROM (
    SELECT p_brand, unnest(generate_series(min(created)::TIMESTAMP, max(created)::TIMESTAMP,
      INTERVAL 1 DAY))::DATE AS created FROM series GROUP BY p_brand) d
  LEFT JOIN series s USING (p_brand, created))"""


def _interpolated(key: str, source: str = "dense", value: str = "y") -> str:
    back = o.over(key, "created", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    ahead = o.over(key, "created", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
    known = f"CASE WHEN {value} IS NOT NULL THEN created END"
    return f"""SELECT * EXCLUDE (d0, d1, y0, y1), coalesce({value},
    y0 + (y1 - y0) * (created - d0) / (d1 - d0), y0, y1) AS filled
  FROM (SELECT *,
    last_value({known} IGNORE NULLS) {back} AS d0, last_value({value} IGNORE NULLS) {back} AS y0,
    first_value({known} IGNORE NULLS) {ahead} AS d1, first_value({value} IGNORE NULLS) {ahead} AS y1
    FROM {source})"""


_SPLIT = f"""CASE WHEN row_number() {o.over(BRAND, "created")} - 1
    < trunc(count(*) {o.over(BRAND)} * {o.TRAIN}) THEN 'train' ELSE 'val' END AS split"""


@query(
    "interpolate_series",
    with_(
        o.series(BRAND) + _DENSE,
        f"SELECT p_brand, created, {r6('filled', 'y')} FROM ({_interpolated(BRAND)})",
    ),
)
def interpolate_series(spark, folder):
    return tidy(calendar.interpolate_linear(target_series(spark, folder), "y", [BRAND]))


@query(
    "time_split",
    with_(o.series(BRAND) + _DENSE, f"SELECT *, {_SPLIT} FROM dense"),
)
def time_split(spark, folder):
    return split.time_split(target_series(spark, folder), RATIO, [BRAND])


@query(
    "interpolate_split",
    with_(
        o.series(BRAND) + _DENSE + f", parts AS (SELECT *, {_SPLIT} FROM dense)",
        f"""SELECT p_brand, created, split, {r6('filled', 'y')}
FROM ({_interpolated("p_brand, split", "parts")})""",
    ),
)
def interpolate_split(spark, folder):
    return tidy(split.interpolate_split(target_series(spark, folder), RATIO, [BRAND]))


_COVARIATES = """covariates AS (
  SELECT p_brand, created, coalesce(sum(adSpend), 0.0) AS adSpend,
    coalesce(max(event_start), 0)::DOUBLE AS event_start FROM trimmed GROUP BY ALL)"""


@query(
    "known_covariates",
    with_(
        o.trimmed(BRAND) + ",\n" + _COVARIATES + ",\n" + o.series(BRAND) + _DENSE,
        f"""SELECT p_brand, created, y, coalesce(adSpend, 0.0) AS adSpend,
  coalesce(event_start, 0.0) AS event_start,
  coalesce(lead(coalesce(event_start, 0.0)) {o.over(BRAND, "created")}, 0.0) AS event_start_next_1
FROM dense LEFT JOIN covariates USING (p_brand, created)""",
    ),
)
def known_covariates(spark, folder):
    return covariates.attach_covariates(
        target_series(spark, folder), trimmed_by_brand(spark, folder), [BRAND]
    )


def _model_frame_sql(value: str = "filled") -> str:
    dense = """, dense AS (
  SELECT d.p_brand, d.created, orders::DOUBLE AS y FROM (
    SELECT p_brand, unnest(generate_series(min(created)::TIMESTAMP, max(created)::TIMESTAMP,
      INTERVAL 1 DAY))::DATE AS created FROM trimmed GROUP BY p_brand) d
  LEFT JOIN trimmed USING (p_brand, created))"""
    return with_(
        o.trimmed(BRAND) + ",\n" + _COVARIATES + dense,
        f"""SELECT p_brand, created, {r6("filled", "orders")}, coalesce(adSpend, 0.0) AS adSpend,
  coalesce(event_start, 0.0) AS event_start,
  coalesce(lead(coalesce(event_start, 0.0)) {o.over(BRAND, "created")}, 0.0) AS event_start_next_1,
  row_number() {o.over(BRAND, "created")} - 1 AS time_idx, p_brand AS series_id,
  CAST(month(created) AS VARCHAR) AS month, CAST(isodow(created) - 1 AS VARCHAR) AS weekday
FROM ({_interpolated(BRAND)}) LEFT JOIN covariates USING (p_brand, created)""",
    )


@query("model_frame", _model_frame_sql())
def model_frame(spark, folder):
    return tidy(covariates.model_frame(trimmed_by_brand(spark, folder), "orders", [BRAND]))


@query(
    "adspend_scale",
    with_(
        o.trimmed(BRAND)
        + f""", frame AS (
  SELECT p_brand, ln(1 + coalesce(adSpend, 0.0)) AS v,
    row_number() {o.over(BRAND, "created")} - 1 AS i, count(*) {o.over(BRAND)} AS n FROM trimmed)""",
        f"""SELECT p_brand, {r6("avg(v)", "log_mean")},
  {r6("coalesce(nullif(stddev_samp(v), 0), 1.0)", "log_std")}
FROM frame WHERE i < trunc(n * {o.TRAIN}) GROUP BY p_brand""",
    ),
)
def adspend_scale(spark, folder):
    return tidy(covariates.ad_spend_scale(_indexed(spark, folder), [BRAND], ratio=RATIO))


def _indexed(spark, folder):
    index = F.row_number().over(calendar.by_day([BRAND])) - 1
    return trimmed_by_brand(spark, folder).withColumn("time_idx", index)


@query(
    "adspend_scaled",
    with_(
        o.trimmed(BRAND)
        + f""", frame AS (
  SELECT p_brand, created, ln(1 + coalesce(adSpend, 0.0)) AS v, coalesce(adSpend, 0.0) AS spend,
    row_number() {o.over(BRAND, "created")} - 1 AS i, count(*) {o.over(BRAND)} AS n FROM trimmed),
scale AS (
  SELECT p_brand, avg(v) AS m, coalesce(nullif(stddev_samp(v), 0), 1.0) AS s
  FROM frame WHERE i < trunc(n * {o.TRAIN}) GROUP BY p_brand)""",
        f"""SELECT p_brand, created, {r6("(v - m) / s", "scaled")},
  CAST(0 AS DOUBLE) AS lost FROM frame JOIN scale USING (p_brand)""",
    ),
)
def adspend_scaled(spark, folder):
    """Spend scaled with its training statistics, and what the inverse of that loses."""
    rows = _indexed(spark, folder)
    scale = covariates.ad_spend_scale(rows, [BRAND], ratio=RATIO)
    rows = rows.withColumn("_spend", F.coalesce("adSpend", F.lit(0.0)))
    scaled = covariates.scale_ad_spend(rows, scale, [BRAND]).join(scale, BRAND)
    restored = covariates.unscale_ad_spend(F.col("adSpend"), F.struct("log_mean", "log_std"))
    lost = F.round(restored - F.col("_spend"), 4) + F.lit(0.0)
    return tidy(scaled.select(BRAND, DAY, F.col("adSpend").alias("scaled"), lost.alias("lost")))


def _panel_sql(key=None):
    names = ", ".join(r6(c) for c in o.FEATURES)
    return with_(o.panel(key), f"SELECT {o.key_list(key)}created, {names} FROM panel")


@query("feature_panel", _panel_sql())
def feature_panel(spark, folder):
    return tidy(Retail(spark, folder).panel())


@query("feature_panel_by_brand", _panel_sql(BRAND))
def feature_panel_by_brand(spark, folder):
    return tidy(Retail(spark, folder).panel(BRAND))


def _window_digest_sql(key=None):
    frame = o.over(key, "created", "ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING")
    return with_(
        o.panel(key)
        + f""", framed AS (
  SELECT {o.key_list(key)}created, orders AS y, count(*) {frame} AS n_rows,
    sum(orders) {frame} AS sum_orders, first_value(adSpend) {frame} AS first_adSpend,
    last_value(event_start_next_1) {frame} AS last_event_start_next_1
  FROM panel)""",
        f"""SELECT {o.key_list(key)}created, {r6("y")}, n_rows::INT AS n_rows,
  {len(o.FEATURES)} AS n_features, {r6("sum_orders")}, {r6("first_adSpend")},
  {r6("last_event_start_next_1")}
FROM framed WHERE n_rows = 28""",
    )


def _window_digest(spark, folder, key=None):
    keys = [key] if key else []
    panel = Retail(spark, folder).panel(key)
    return _digest(windows.sliding_windows(panel, list(o.FEATURES), keys=keys), o.FEATURES, keys)


def _digest(framed, names, keys):
    orders, spend = list(names).index("orders"), list(names).index("adSpend")
    total = F.aggregate(
        F.transform("X", lambda r: r[orders]), F.lit(0.0), lambda a, v: a + v
    )
    return tidy(
        framed.select(
            *keys,
            DAY,
            "y",
            F.size("X").alias("n_rows"),
            F.size(F.col("X")[0]).alias("n_features"),
            total.alias("sum_orders"),
            F.col("X")[0][spend].alias("first_adSpend"),
            F.element_at(F.element_at("X", -1), -1).alias("last_event_start_next_1"),
        )
    )


@query("windows_round_trip", _window_digest_sql())
def windows_round_trip(spark, folder):
    """Windows written with their feature order and read back."""
    framed = windows.sliding_windows(Retail(spark, folder).panel(), list(o.FEATURES))
    path = files.write_windows(framed, staged_path(spark, "windows"), list(o.FEATURES))
    read, names = files.read_windows(spark, path)
    return _digest(read, names, [])


@query("sliding_windows", _window_digest_sql())
def sliding_windows(spark, folder):
    return _window_digest(spark, folder)


@query("sliding_windows_by_brand", _window_digest_sql(BRAND))
def sliding_windows_by_brand(spark, folder):
    return _window_digest(spark, folder, BRAND)


_SCALER_PARTS = "\nUNION ALL ".join(
    f"""SELECT p_brand, '{c}' AS "column", avg({c}) AS mean, stddev_pop({c}) AS std
FROM seen GROUP BY p_brand"""
    for c in o.FEATURES
)


@query(
    "standardize_windows",
    with_(
        o.panel(BRAND)
        + f""", placed AS (
  SELECT *, row_number() {o.over(BRAND, "created")} - 1 AS i, count(*) {o.over(BRAND)} AS n
  FROM panel),
targets AS (
  SELECT p_brand, i AS j, orders AS y FROM placed
  WHERE i >= 28 AND i < 28 + trunc((n - 28) * {o.TRAIN})),
seen AS (
  SELECT placed.* FROM placed JOIN targets
    ON placed.p_brand = targets.p_brand AND i BETWEEN j - 28 AND j - 1),
stats AS (
  {_SCALER_PARTS}
  UNION ALL SELECT p_brand, '(target)', avg(y), stddev_pop(y) FROM targets GROUP BY p_brand)""",
        f"""SELECT p_brand, "column", {o.r6("mean")},
  {o.r6("CASE WHEN std = 0 THEN 1 ELSE std END", "std")} FROM stats""",
    ),
)
def standardize_windows(spark, folder):
    panel = Retail(spark, folder).panel(BRAND)
    return tidy(windows.window_scaler(panel, list(o.FEATURES), keys=[BRAND]))


@query(
    "standardized_windows",
    with_(
        o.panel()
        + f""", placed AS (
  SELECT *, row_number() {o.over(None, "created")} - 1 AS i, count(*) {o.over(None)} AS n FROM panel),
targets AS (SELECT i AS j, orders AS y FROM placed WHERE i >= 28 AND i < 28 + trunc((n - 28) * {o.TRAIN})),
seen AS (SELECT placed.* FROM placed JOIN targets ON i BETWEEN j - 28 AND j - 1),
inputs AS (SELECT avg(orders) AS m, coalesce(nullif(stddev_pop(orders), 0), 1) AS s FROM seen),
goal AS (SELECT avg(y) AS m, coalesce(nullif(stddev_pop(y), 0), 1) AS s FROM targets),
framed AS (
  SELECT created, i, orders, sum(orders) {o.over(None, "created", "ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING")} AS total
  FROM placed)""",
        f"""SELECT created, {r6("(orders - goal.m) / goal.s", "y")},
  {r6("(total - 28 * inputs.m) / inputs.s", "sum_orders")} FROM framed, inputs, goal WHERE i >= 28""",
    ),
)
def standardized_windows(spark, folder):
    """Target and summed order inputs of every window, standardised by the training windows."""
    panel = Retail(spark, folder).panel()
    scaler = windows.window_scaler(panel, list(o.FEATURES))
    framed = windows.sliding_windows(panel, list(o.FEATURES))
    scaled = windows.standardize_windows(framed, scaler, list(o.FEATURES))
    at = o.FEATURES.index("orders")
    total = F.aggregate(F.transform("X", lambda r: r[at]), F.lit(0.0), lambda a, v: a + v)
    return tidy(scaled.select(DAY, "y", total.alias("sum_orders")))

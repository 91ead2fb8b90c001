import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import column, day
from dayloom.operators import features, forecast, importance, models, smoothing, windows
from dayloom.operators.evaluate import metrics_by_model
from dayloom.plans import flows
from dayloom.sources import files

N = 90


def raw_panel(n=N, seed=2):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2024-01-01", periods=n)
    return pd.DataFrame(
        {
            "created": days.date,
            "orders": 20 + 5 * np.sin(2 * np.pi * days.dayofweek / 7) + rng.normal(0, 1, n),
            "adSpend": rng.integers(50, 90, n).astype(float),
            "totalRevenue": rng.integers(500, 900, n).astype(float),
            "created_weekday": days.dayofweek,
            "created_month": days.month,
            "event_start": (days.day == 15).astype(int),
        }
    )


@pytest.fixture(scope="module")
def panel(spark):
    out = features.feature_panel(spark.createDataFrame(raw_panel()), lags=(1, 7))
    return spark.createDataFrame(out.toPandas()).withColumn("created", F.to_date("created"))


@pytest.fixture(scope="module")
def framed(panel):
    return windows.sliding_windows(panel, window=7)


@pytest.fixture(scope="module")
def ridge(framed):
    train, _ = models.prepared_windows(framed, 0.2)
    return models.fit_window_model("ridge", train)


def test_ridge_equals_the_closed_form(spark, framed):
    train, validation = models.prepared_windows(framed, 0.2)
    fitted = models.fit_window_model("ridge", train, {"ridge_alpha": 5.0})
    rows = train.orderBy("created").collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.y for r in rows])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(x.shape[1]), xc.T @ yc)
    assert fitted.coefficients.toArray() == pytest.approx(w, abs=1e-6)
    held = validation.orderBy("created").collect()
    assert len(rows) == int((N - 7) * 0.8) and len(rows) + len(held) == N - 7
    xv = np.array([r.features.toArray() for r in held])
    want = (xv - x.mean(axis=0)) @ w + y.mean()
    errors = models.validation_errors("ridge", fitted, validation)
    assert column(errors, "y_pred", "sample_idx") == pytest.approx(list(want), abs=1e-6)


def test_comparison_isolates_failures(spark, panel, framed):
    result = models.compare_models(
        framed,
        panel,
        models=("ridge", "random_forest", "sarima", "baseline_tm7_sw8_blend", "exponential_smoothing"),
        options={"random_forest_n_estimators": 3, "random_forest_max_depth": None},
    )
    rows = {r.model: r for r in result.metrics.collect()}
    assert rows["sarima"].error and rows["sarima"].mae is None
    for name in ("ridge", "random_forest", "baseline_tm7_sw8_blend", "exponential_smoothing"):
        assert rows[name].error is None and 0 < rows[name].mae < 10
    again = {r.model: r.mae for r in metrics_by_model(result.errors).collect()}
    assert again["ridge"] == pytest.approx(rows["ridge"].mae)
    record = models.promote(result, "orders").first()
    assert rows[record.model_name].mae == min(r.mae for r in rows.values() if r.mae)
    assert record.predict_strategy == "winner"


def test_grid_expansion():
    sizes = {
        "forest": ({"n": [100, 200, 300, 400, 500], "d": [None, 8, 16], "s": [2, 3, 4, 5], "l": [1, 2, 3]}, 180),
        "boosted": ({"n": [200, 300, 400, 500], "d": [4, 6], "r": [0.01, 0.05], "s": [0.9, 1.0], "c": [0.8, 1.0]}, 64),
        "boosted_2": ({"i": [200, 500], "r": [0.03, 0.05, 0.1], "d": [4, 6, 8]}, 18),
        "ridge": ({"ridge_alpha": [0.1, 1.0, 5, 10.0]}, 4),
        "baseline": ({"t": [7, 14], "w": [4, 8, 12], "a": [0.45], "b": [0.55]}, 6),
        "empty": ({}, 1),
        "none": (None, 1),
        "scalars": ({"a": "text", "b": 3, "c": range(2)}, 2),
    }
    for grid, size in sizes.values():
        assert len(models.expand_grid(grid)) == size
    assert models.expand_grid({"a": [1, 2], "b": [3, 4]})[:2] == [{"a": 1, "b": 3}, {"a": 1, "b": 4}]
    with pytest.raises(ValueError):
        models.expand_grid({"a": []})


def test_grid_search_keeps_errors_and_first_best(spark, framed, panel):
    out = models.grid_search(
        "ridge", {"ridge_alpha": [1.0, -5.0, 1.0]}, windows=framed
    ).orderBy("run_id")
    rows = out.collect()
    assert rows[1].error and rows[1].mae is None
    assert rows[0].mae == rows[2].mae
    assert models.best_run(out).first().run_id == 0
    grid = {"baseline_trailing_days": [3, "bad", 7]}
    tested = models.grid_search("baseline_tm7_sw8_blend", grid, panel=panel).orderBy("run_id")
    rows = tested.collect()
    assert [r.error is None for r in rows] == [True, False, True]
    assert rows[0].mae != rows[2].mae and rows[1].mae is None
    smooth = models.grid_search("exponential_smoothing", {}, panel=panel).collect()
    assert len(smooth) == 1 and smooth[0].mae > 0
    with pytest.raises(ValueError):
        models.grid_search("other", {}, windows=framed)
    with pytest.raises(ValueError):
        models.best_run(out, "r2")


def test_importance_sums_steps(spark, panel, ridge):
    names = features.numeric_columns(panel)
    table = importance.feature_importance(spark, ridge, names, 7)
    weights = np.abs(ridge.coefficients.toArray()).reshape(7, -1).sum(axis=0)
    got = {r.feature: r for r in table.collect()}
    assert got["orders"].importance == pytest.approx(weights[names.index("orders")])
    assert sum(r.importance_pct for r in got.values()) == pytest.approx(100)
    flat = importance.flat_feature_names(["a", "b"], 2)
    assert flat == ["a@t-1", "b@t-1", "a@t-0", "b@t-0"]
    with pytest.raises(ValueError):
        importance.feature_importance(spark, ridge, names, 8)


def pandas_recursion(pdf, model, days, window, spend=None, events=None, gap=0, mode="reference"):
    """Future rows one by one, as a plain loop."""
    names = [c for c in pdf.columns if c != "created"]
    rows = pdf[names].to_numpy(dtype=float).tolist()
    at = {c: i for i, c in enumerate(names)}
    last = pdf["created"].iloc[-1]
    out = []
    for step in range(1, gap + days + 1):
        d = last + dt.timedelta(days=step)
        before = rows[-1]
        row = list(before)
        row[at["created_weekday"]], row[at["created_month"]] = d.weekday(), d.month
        row[at["created_weekday_sin"]] = np.sin(2 * np.pi * d.weekday() / 7)
        row[at["created_weekday_cos"]] = np.cos(2 * np.pi * d.weekday() / 7)
        row[at["created_month_sin"]] = np.sin(2 * np.pi * d.month / 12)
        row[at["created_month_cos"]] = np.cos(2 * np.pi * d.month / 12)
        if spend and d in spend:
            row[at["adSpend"]] = spend[d]
        for k in (1, 7):
            row[at[f"orders_lag_{k}"]] = rows[-k][at["orders"]]
            row[at[f"adSpend_lag_{k}"]] = rows[-k][at["adSpend"]]
        for c, s in (("revenue_growth", "totalRevenue"), ("investment_growth", "adSpend")):
            if before[at[s]] != 0:
                row[at[c]] = (row[at[s]] - before[at[s]]) / before[at[s]]
        if events is not None:
            row[at["event_start"]] = float(events.get(d, 0) >= 0.5)
            tomorrow = d + dt.timedelta(days=1)
            row[at["event_start_next_1"]] = float(events.get(tomorrow, 0) >= 0.5)
        else:
            row[at["event_start_next_1"]] = 0.0
        if step > gap:
            seen = rows + [row] if mode == "reference" else rows
            x = np.array(seen[-window:]).reshape(-1)
            row[at["orders"]] = float(model(x))
        rows.append(row)
        out.append((d, dict(zip(names, row))))
    return out[gap:]


def linear(model):
    w, b = model.coefficients.toArray(), model.intercept
    return lambda x: x @ w + b


@pytest.mark.parametrize("mode", ["reference", "consistent"])
@pytest.mark.parametrize("gap", [0, 3])
def test_recursive_forecast_like_a_loop(spark, panel, ridge, gap, mode):
    pdf = panel.orderBy("created").toPandas()
    last = pdf["created"].iloc[-1]
    ahead = [last + dt.timedelta(days=i) for i in range(1, 13)]
    spend = {ahead[1]: 500.0, ahead[4]: 0.0}
    events = {ahead[0]: 0.2, ahead[3]: 1.0, ahead[5]: 0.5}
    want = pandas_recursion(pdf, linear(ridge), 8, 7, spend, events, gap, mode)
    tables = [
        spark.createDataFrame(list(m.items()), "created date, value double") for m in (spend, events)
    ]
    out = forecast.recursive_forecast(
        panel,
        ridge,
        8,
        window=7,
        first=str(ahead[gap]) if gap else None,
        ad_spend=tables[0],
        events=tables[1],
        mode=mode,
    )
    rows = out.orderBy("created").collect()
    assert [r.created for r in rows] == [d for d, _ in want]
    for r, (_, row) in zip(rows, want):
        assert r.prediction == pytest.approx(row["orders"])
        for c, v in row.items():
            assert r[c] == pytest.approx(v, abs=1e-9), c


def test_tree_steps_like_a_loop(spark, panel, framed):
    train, _ = models.prepared_windows(framed, 0.2)
    forest = models.fit_window_model("random_forest", train, {"random_forest_n_estimators": 3})
    from pyspark.ml.linalg import Vectors

    pdf = panel.orderBy("created").toPandas()
    want = pandas_recursion(pdf, lambda x: forest.predict(Vectors.dense(x)), 5, 7)
    out = forecast.recursive_forecast(panel, forest, 5, window=7, steps_per_cut=2)
    got = column(out, "prediction")
    assert got == pytest.approx([row["orders"] for _, row in want])


def test_linear_and_stepwise_paths_agree_per_key(spark, panel, ridge):
    keyed = panel.withColumn("k", F.lit("a")).unionByName(
        panel.filter("created < '2024-03-20'").withColumn("k", F.lit("b"))
    )
    folded = forecast.recursive_forecast(keyed, ridge, 4, ["k"], window=7)
    plan = forecast.Recursion(features.numeric_columns(panel), features.numeric_columns(panel), "orders", 7)
    state = forecast.series_state(keyed, plan, ["k"])
    stepped = forecast._stepwise(state, plan, ridge, None, 4, ["k"], 3)
    key = lambda r: (r.k, r.created)
    one, two = sorted(folded.collect(), key=key), sorted(stepped.collect(), key=key)
    assert len(one) == len(two) == 8
    for a, b in zip(one, two):
        assert a.prediction == pytest.approx(b.prediction)


def test_carried_panel_without_overrides(panel):
    pdf = panel.orderBy("created").toPandas()
    rows = forecast.future_panel(panel, 9).orderBy("created").collect()
    tail = pdf.iloc[-1]
    assert {r.orders for r in rows} == {tail["orders"]}
    assert {r.event_start for r in rows} == {tail["event_start"]}
    assert {r.event_start_next_1 for r in rows} == {0.0}
    assert rows[7].orders_lag_7 == tail["orders"]
    assert rows[2].orders_lag_7 == pdf["orders"].iloc[-5]


def test_forecast_errors(spark, panel, ridge):
    with pytest.raises(Exception, match="inside the observed"):
        forecast.recursive_forecast(panel, ridge, 2, window=7, first="2024-01-05").collect()
    with pytest.raises(Exception, match="not enough history"):
        short = panel.filter("created > '2024-03-28'")
        forecast.recursive_forecast(short, ridge, 2, window=7).collect()
    with pytest.raises(ValueError):
        forecast.recursive_forecast(panel, ridge, 2, window=7, mode="other")


def test_commercial_columns(spark):
    panel = spark.createDataFrame(
        [(day(0), 1.234, 5.0), (day(2), None, 7.777)], "created date, adSpend double, totalRevenue double"
    )
    daily = spark.createDataFrame([(day(i), None) for i in (0, 1, 2, 3)], "created date, adSpend double")
    rows = forecast.fill_commercial(daily, panel).orderBy("created").collect()
    assert [(r.adSpend, r.rcRevenue, r.totalRevenue) for r in rows] == [
        (1.23, None, 5.0),
        (None, None, None),
        (None, None, 7.78),
        (None, None, 7.78),
    ]
    given = daily.withColumn("adSpend", F.lit(9.0))
    kept = forecast.fill_commercial(given, panel).orderBy("created").collect()
    assert [r.adSpend for r in kept] == [9.0] * 4
    redone = forecast.fill_commercial(given, panel, only_missing=False).orderBy("created").collect()
    assert redone[0].adSpend == 1.23 and redone[3].adSpend is None


def test_smoothing_recovers_a_weekly_pattern(spark, series_of):
    pattern = [10, 12, 9, 14, 20, 25, 5]
    values = [pattern[i % 7] + 0.5 * i for i in range(70)]
    out = smoothing.smoothing_forecast(series_of(values), 14)
    got = column(out, "prediction")
    want = [pattern[i % 7] + 0.5 * i for i in range(70, 84)]
    assert got == pytest.approx(want)
    later = smoothing.smoothing_forecast(series_of(values), 4, first="2024-03-15")
    assert column(later, "created") == [dt.date(2024, 3, 15) + dt.timedelta(days=i) for i in range(4)]
    assert column(later, "prediction") == pytest.approx(got[4:8])
    short = smoothing.smoothing_forecast(series_of([1, 2, 3, 4]), 2)
    assert column(short, "prediction") == pytest.approx([5, 6])


def numpy_smoothing(y, steps, grid):
    """Forecast ``steps`` values with the grid point of least squared one-step error.

    All grid points advance together as vectors. The season takes part from two full weeks on.
    """
    alpha, beta, gamma = np.asarray(grid, dtype=float).T
    seasonal = len(y) >= 2 * 7
    # The state before the first day: a line through the first two weeks, the first week's
    # distance from it as the season.
    if seasonal:
        first, second = y[:7].mean(), y[7 : 2 * 7].mean()
        slope = (second - first) / 7
        start = first - slope * (7 + 1) / 2
        offsets = y[:7] - (start + slope * np.arange(1, 7 + 1))
    else:
        slope = y[1] - y[0] if len(y) > 1 else 0.0
        start, offsets, gamma = y[0] - slope, np.zeros(7), np.zeros_like(gamma)
    level, trend = np.full(len(alpha), start), np.full(len(alpha), slope)
    season = np.tile(offsets, (len(alpha), 1)).T
    loss = np.zeros(len(alpha))
    for t, value in enumerate(y):
        s = season[t % 7]
        expected = level + trend
        loss += (value - expected - s) ** 2
        raised = alpha * (value - s) + (1 - alpha) * expected
        trend = beta * (raised - level) + (1 - beta) * trend
        season[t % 7] = gamma * (value - expected) + (1 - gamma) * s
        level = raised
    best = int(loss.argmin())
    ahead = np.arange(1, steps + 1)
    pattern = season[(len(y) + ahead - 1) % 7, best]
    return level[best] + ahead * trend[best] + pattern, grid[best], float(loss[best])


@pytest.mark.parametrize("n", [1, 2, 9, 14, 15, 40, 200])
def test_smoothing_equals_numpy(series_of, n):
    rng = np.random.default_rng(n)
    values = 50 + 0.3 * np.arange(n) + 8 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(0, 2, n)
    want, point, loss = numpy_smoothing(values, 10, smoothing.GRID)
    rows = smoothing.smoothing_forecast(series_of(list(values)), 10, rounds=0).orderBy("created").collect()
    assert [r.prediction for r in rows] == pytest.approx(list(want))
    assert (rows[0].alpha, rows[0].beta, rows[0].gamma) == point
    assert rows[0].sse == pytest.approx(loss)


@pytest.mark.parametrize("n", [3, 15, 90])
def test_refined_smoothing_reaches_a_minimum(series_of, n):
    """Never above the grid, and as low as a much finer search around what was found."""
    rng = np.random.default_rng(n)
    values = 20 + 0.1 * np.arange(n) + 5 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(0, 1, n).cumsum()
    coarse = smoothing.smoothing_forecast(series_of(list(values)), 1, rounds=0).first()
    fine = smoothing.smoothing_forecast(series_of(list(values)), 1, rounds=200, tolerance=1e-5).first()
    assert fine.sse <= coarse.sse
    again = smoothing.smoothing_forecast(
        series_of(list(values)), 1, rounds=0, grid=[(fine.alpha, fine.beta, fine.gamma)]
    ).first()
    assert again.sse >= fine.sse * (1 - 1e-9)  # the level's shift can only lower it
    near = [
        (min(max(fine.alpha + i, 1e-4), 0.9999), min(max(fine.beta + j, 1e-4), 0.9999), min(max(fine.gamma + k, 1e-4), 0.9999))
        for i in (-0.01, 0, 0.01) for j in (-0.01, 0, 0.01) for k in (-0.01, 0, 0.01)
    ]
    around = smoothing.smoothing_forecast(series_of(list(values)), 1, rounds=0, grid=near).first()
    assert fine.sse <= around.sse * (1 + 1e-6)


def test_smoothing_backtest_covers_validation(series_of):
    values = [3.0 + i % 7 for i in range(50)]
    out = smoothing.smoothing_backtest(series_of(values), ratio=0.2)
    assert out.count() == 50 - int(50 * (1 - 0.2))
    assert out.agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred")))).first()[0] < 0.5


def test_training_flow_and_winner_forecast(spark, panel, tmp_path):
    comparison, record = flows.train_and_promote(
        panel, window=7, models=("ridge", "baseline_tm7_sw8_blend"), path=str(tmp_path)
    )
    winner = record.first().asDict()
    stored = spark.read.json(f"{tmp_path}/best_model.json").first()
    assert stored.model_name == winner["model_name"]
    errors = spark.read.json(f"{tmp_path}/mape_distribution.jsonl")
    assert {r.model for r in errors.select("model").distinct().collect()} == {
        "ridge", "baseline_tm7_sw8_blend",
    }
    metrics = spark.read.json(f"{tmp_path}/metrics.json")
    assert files.metrics_rows(metrics).count() == 2
    with pytest.raises(ValueError):
        flows.train_and_promote(panel.limit(5), window=7, models=("ridge",))
    for name in ("ridge", "baseline_tm7_sw8_blend", "exponential_smoothing"):
        out = flows.forecast_winner(
            {**winner, "model_name": name}, comparison.fitted.get(name), panel, 3, window=7
        )
        rows = out.collect()
        assert len(rows) == 3
        assert {r.model_name for r in rows} == {name}
        assert {r.future_overrides_supported for r in rows} == {name == "ridge"}
        assert all(r.totalRevenue is not None for r in rows)
    with pytest.raises(ValueError):
        flows.forecast_winner({"model_name": "sarima"}, None, panel, 3)


def test_datasets_to_features_flow(spark):
    rows = [(day(i % 40), f"c{i % 9}", 1 + i % 3) for i in range(200)]
    lines = spark.createDataFrame(rows, "created date, customerId string, order_number_for_customer int")
    spends = spark.range(45).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        *[F.col("id").cast("double").alias(c) for c in ("adSpend", "rcRevenue", "totalRevenue")],
        *[
            F.col("id").alias(c)
            for c in ("totalMerchSold", "totalNewCustomerBarsSold", "totalRecurringCustomerBarsSold")
        ],
    )
    out = flows.build_features(lines, spends)
    assert out.count() == 44 and len(out.columns) == 26
    assert not any(out.filter(F.col(c).isNull()).count() for c in ("orders", "orders_lag_30"))


def test_metrics_json_round_trip(spark):
    df = spark.createDataFrame(
        [("ridge", 1.0, 2.0, 0.1, None), ("lstm", None, None, None, "missing")],
        "model string, mae double, rmse double, mape double, error string",
    )
    rows = files.metrics_rows(files.metrics_json(df)).collect()
    assert [tuple(r) for r in rows] == [("ridge", 1.0, 2.0, 0.1)]


def test_aligned_comparison_scores_the_same_days(spark, panel, framed):
    chosen = ("ridge", "baseline_tm7_sw8_blend")
    aligned = models.compare_models(framed, panel, models=chosen, align=True)
    counts = {r.model: r["count"] for r in aligned.errors.groupBy("model").count().collect()}
    assert counts["ridge"] == counts["baseline_tm7_sw8_blend"] == N - 7 - int((N - 7) * 0.8)
    loose = models.compare_models(framed, panel, models=chosen)
    assert loose.errors.filter("model <> 'ridge'").count() == N - int(N * 0.8)


def test_build_datasets(spark, tmp_path):
    orders = spark.sql(
        """SELECT 1 AS id, timestamp'2024-01-02 10:00:00' AS created, 'c' AS customerId,
             array(named_struct('productId', '7', 'title', 't', 'quantity', '2')) AS line_items"""
    )
    spends = spark.sql(
        """SELECT date'2024-01-02' AS date, '1' AS adSpend, '2' AS rcRevenue, '3' AS totalRevenue,
             '4' AS totalMerchSold, '5' AS totalNewCustomerBarsSold,
             '6' AS totalRecurringCustomerBarsSold"""
    )
    events = spark.sql("SELECT '2024-01-02' AS startDate")
    paths = flows.build_datasets(orders, spends, events, str(tmp_path), fmt="both")
    assert set(paths) == {"orders", "ad_spends", "events"}
    for written in paths.values():
        assert spark.read.json(written["jsonl"]).count() == 1
        assert spark.read.csv(written["csv"], header=True).count() == 1


def test_missing_model_features_count_as_zero(panel, ridge):
    names = features.numeric_columns(panel)
    whole = forecast.recursive_forecast(
        panel.withColumn("event_start_next_1", F.lit(0.0)), ridge, 3, features=names, window=7
    )
    lacking = panel.drop("event_start_next_1")
    out = forecast.recursive_forecast(lacking, ridge, 3, features=names, window=7)
    assert column(out, "prediction") == pytest.approx(column(whole, "prediction"))


def test_forecast_inputs_are_taken_by_name(panel, ridge):
    want = column(forecast.recursive_forecast(panel, ridge, 3), "prediction")
    reordered = panel.select("created", *reversed([c for c in panel.columns if c != "created"]))
    assert column(forecast.recursive_forecast(reordered, ridge, 3), "prediction") == pytest.approx(want)
    extra = panel.withColumn("another", F.lit(1e6))
    assert column(forecast.recursive_forecast(extra, ridge, 3), "prediction") == pytest.approx(want)
    winner = {"model_name": "ridge"}
    out = flows.forecast_winner(winner, ridge, extra, 3)
    assert column(out, "prediction") == pytest.approx([round(v, 2) for v in want], abs=0.01)
    with pytest.raises(ValueError, match="model inputs"):
        forecast.recursive_forecast(panel, ridge, 3, features=["orders"], window=7)
    names = ridge.feature_columns
    del ridge.feature_columns
    try:
        with pytest.raises(ValueError, match="does not know"):
            forecast.recursive_forecast(panel, ridge, 3)
    finally:
        ridge.feature_columns = names


def test_far_first_day_on_both_paths(panel, ridge, framed):
    train, _ = models.prepared_windows(framed, 0.2)
    forest = models.fit_window_model("random_forest", train, {"random_forest_n_estimators": 2})
    first = str(panel.agg(F.date_add(F.max("created"), 6)).first()[0])
    for model in (ridge, forest):
        assert forecast.recursive_forecast(panel, model, 2, first=first).count() == 2


@pytest.mark.parametrize("name", ["ridge", "random_forest", "baseline_tm7_sw8_blend"])
def test_stored_winner_forecasts_from_its_path(panel, tmp_path, name):
    options = {"random_forest_n_estimators": 3}
    comparison, record = flows.train_and_promote(
        panel, window=7, models=(name,), options=options, path=str(tmp_path)
    )
    direct = flows.forecast_winner(record.first().asDict(), comparison.fitted[name], panel, 4)
    reordered = panel.select("created", *reversed([c for c in panel.columns if c != "created"]))
    loaded = flows.forecast_stored(str(tmp_path), reordered, 4)
    assert column(loaded, "prediction") == pytest.approx(column(direct, "prediction"))
    row = record.first()
    assert (row.features is None) == (name == "baseline_tm7_sw8_blend")
    assert row.window == (None if row.features is None else 7)


def test_runs_without_a_different_effect_are_fitted_once(framed, monkeypatch):
    fits = []
    whole = models.fit_window_model
    monkeypatch.setattr(models, "fit_window_model", lambda *a: fits.append(a) or whole(*a))
    grid = {"random_forest_n_estimators": [1], "random_forest_min_samples_split": [2, 3, 4]}
    rows = models.grid_search("random_forest", grid, windows=framed).collect()
    assert len(rows) == 3 and len(fits) == 1 and len({r.mae for r in rows}) == 1


def test_record_is_exactly_one_row(spark, tmp_path):
    for rows in (0, 2):
        with pytest.raises(ValueError):
            files.write_record(spark.range(rows), str(tmp_path / "record.json"))

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import column, day
from dayloom.operators import baseline, calendar, windows
from dayloom.operators.models import expand_grid


def panel_of(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "created": pd.date_range("2024-01-01", periods=n).date,
            "orders": rng.normal(50, 9, n),
            "adSpend": rng.normal(1e6, 3, n),
            "flat": np.ones(n),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def numpy_windows(pdf, window):
    values = pdf[["orders", "adSpend", "flat"]].to_numpy()
    x = np.stack([values[i - window : i] for i in range(window, len(values))])
    return x, pdf["orders"].to_numpy()[window:]


def test_windows_equal_numpy(spark):
    pdf, df = panel_of(spark, 12)
    x, y = numpy_windows(pdf, 5)
    out = windows.flatten_windows(windows.sliding_windows(df, window=5)).orderBy("created").collect()
    assert np.allclose([r.y for r in out], y)
    assert np.allclose(np.array([r.X for r in out]), x)
    assert np.allclose([r.features.toArray() for r in out], x.reshape(len(y), -1))


def test_window_limits(spark):
    _, df = panel_of(spark, 29)
    assert windows.sliding_windows(df, window=28).count() == 1
    with pytest.raises(ValueError):
        windows.require_windows(windows.sliding_windows(df.filter("created < '2024-01-29'")))
    with pytest.raises(ValueError):
        windows.sliding_windows(df, window=0)
    with pytest.raises(ValueError):
        windows.sliding_windows(df, target="missing")


def test_scaler_equals_numpy_over_all_windows(spark):
    pdf, df = panel_of(spark, 40)
    x, y = numpy_windows(pdf, 6)
    cut = int(len(x) * (1 - 0.25))
    names = ["orders", "adSpend", "flat"]
    scaler = windows.window_scaler(df, names, window=6, ratio=0.25)
    got = {r["column"]: (r["mean"], r["std"]) for r in scaler.collect()}
    mean, std = x[:cut].mean(axis=(0, 1)), x[:cut].std(axis=(0, 1))
    for i, c in enumerate(names[:2]):
        assert got[c] == pytest.approx((mean[i], std[i]), rel=1e-9)
    assert got["flat"] == (1.0, 1.0)
    assert got["(target)"] == pytest.approx((y[:cut].mean(), y[:cut].std()))
    scaled = windows.standardize_windows(windows.sliding_windows(df, window=6), scaler, names)
    rows = scaled.orderBy("created").collect()
    std[2] = 1.0
    assert np.allclose(np.array([r.X for r in rows]), (x - mean) / std, atol=1e-6)
    assert np.allclose([r.y for r in rows], (y - y[:cut].mean()) / y[:cut].std())


def predict_pandas(series, target, spec=baseline.Blend()):
    last = series.index.max()
    anchor = last + pd.Timedelta(days=1) if target > last else target
    recent = series[(series.index >= anchor - pd.Timedelta(days=spec.trailing_days)) & (series.index < anchor)].dropna()
    same = series[
        (series.index >= anchor - pd.Timedelta(weeks=spec.weekday_weeks))
        & (series.index < anchor)
        & (series.index.weekday == target.weekday())
    ].dropna()
    parts = [None if s.empty else v for s, v in ((recent, recent.mean()), (same, same.median()))]
    if None not in parts:
        return spec.trailing_weight * parts[0] + spec.weekday_weight * parts[1]
    return next((p for p in parts if p is not None), None)


def random_series(n=120, seed=1):
    rng = np.random.default_rng(seed)
    values = [float(v) if rng.random() > 0.2 else ... for v in rng.integers(0, 30, n)]
    values[0], values[-1] = 5.0, 6.0
    index = pd.date_range("2024-01-01", periods=n)
    known = {i: v for i, v in zip(index, values) if v is not ...}
    return values, pd.Series(known)


@pytest.mark.parametrize("spec", [baseline.Blend(), baseline.Blend(3, 2, 0.7, 0.3)])
def test_backtest_like_pandas(series_of, spec):
    values, series = random_series()
    out = baseline.baseline_backtest(series_of(values), ratio=0.3, spec=spec).orderBy("created").collect()
    start = pd.Timestamp("2024-01-01") + pd.Timedelta(days=int(120 * (1 - 0.3)))
    want = series[series.index >= start]
    assert [pd.Timestamp(r.created) for r in out] == list(want.index)
    assert [r.sample_idx for r in out] == list(range(len(want)))
    for r in out:
        assert r.y_pred == pytest.approx(predict_pandas(series, pd.Timestamp(r.created), spec))


def test_sparse_backtest_equals_dense(series_of):
    values, _ = random_series(seed=9)
    sparse = series_of(values)
    dense = calendar.complete_calendar(sparse)
    one = baseline.baseline_backtest(sparse).orderBy("created").collect()
    two = baseline.baseline_backtest(dense).orderBy("created").collect()
    assert one == two


def test_forecast_like_pandas_and_per_key(spark, series_of):
    values, series = random_series(seed=4)
    single = series_of(values)
    out = baseline.baseline_forecast(single, 10, first="2024-05-03").orderBy("created").collect()
    assert len(out) == 10 and str(out[0].created) == "2024-05-03"
    for r in out:
        assert r.prediction == pytest.approx(predict_pandas(series, pd.Timestamp(r.created)))
    other = series_of(random_series(seed=5)[0][:90])
    keyed = single.withColumn("k", F.lit("a")).unionByName(other.withColumn("k", F.lit("b")))
    both = baseline.baseline_forecast(keyed, 3, ["k"])
    alone = baseline.baseline_forecast(single, 3).orderBy("created").collect()
    mine = both.filter("k = 'a'").drop("k").orderBy("created").collect()
    assert [r.prediction for r in mine] == [r.prediction for r in alone]
    assert both.count() == 6


def test_one_day_forecast_equals_the_component_window(series_of):
    values, _ = random_series(seed=6)
    ahead = baseline.baseline_forecast(series_of(values), 1).first()
    within = baseline.with_components(series_of([*values, 0.0])).filter(
        F.col("created") == F.lit(ahead.created)
    ).first()
    assert ahead.trailing_mean_7 == pytest.approx(within.trailing_mean_7)
    assert ahead.same_weekday_median_8w == within.same_weekday_median_8w


def test_fallback_and_errors(spark, series_of):
    # Three known days: weekdays without history fall back to the trailing mean.
    rows = baseline.baseline_forecast(series_of([1, 2, 6]), 7).orderBy("created").collect()
    assert [r.prediction for r in rows[:4]] == [3.0, 3.0, 3.0, 3.0]
    assert rows[4].prediction == pytest.approx(0.45 * 3 + 0.55 * 1)
    with pytest.raises(Exception, match="inside the observed"):
        baseline.baseline_forecast(series_of([1, 2]), 2, first="2024-01-02").collect()
    for days in (0, 366):
        with pytest.raises(ValueError):
            baseline.baseline_forecast(series_of([1]), days)


def test_heuristic_revenue(spark):
    rows = [(day(i), float(i * i % 17)) for i in range(40)]
    table = spark.createDataFrame(rows, "date date, totalRevenue double")
    series = pd.Series([v for _, v in rows], pd.date_range("2024-01-01", periods=40))
    for method in baseline.METHODS:
        out = baseline.heuristic_revenue(table, "2024-02-05", 8, method=method).orderBy("date")
        for r in out.collect():
            if method == "blend":
                assert r.estimate == pytest.approx(predict_pandas(series, pd.Timestamp(r.date)))
        total = baseline.heuristic_total(out).first()
        assert total.days == 8 and total.all_days_estimated
    early = baseline.heuristic_revenue(table, "2023-12-31", 3)
    summary = baseline.heuristic_total(early).first()
    assert not summary.all_days_estimated
    empty = baseline.heuristic_total(baseline.heuristic_revenue(table, "2020-01-01", 2)).first()
    assert empty.predicted_total_sum == 0.0 and not empty.all_days_estimated
    with pytest.raises(ValueError):
        baseline.heuristic_revenue(table, "2024-01-01", 2, method="other")


def test_baseline_grid_equals_single_backtests(series_of):
    values, _ = random_series(seed=8)
    dense = [3.0 if v is ... else v for v in values]
    grid = expand_grid({"baseline_trailing_days": [7, 14], "baseline_weekday_weeks": [4, 8, 12]})
    out = baseline.baseline_grid(series_of(dense), grid, ratio=0.25).orderBy("run_id").collect()
    assert [(r.trailing_days, r.weekday_weeks) for r in out] == [
        (d, w) for d in (7, 14) for w in (4, 8, 12)
    ]
    for r in out:
        spec = baseline.Blend(r.trailing_days, r.weekday_weeks)
        tested = baseline.baseline_backtest(series_of(dense), ratio=0.25, spec=spec)
        mae = tested.agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred")))).first()[0]
        assert r.mae == pytest.approx(mae)


def test_grid_fills_missing_validation_days(series_of):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, ..., ..., 8.0]
    out = baseline.baseline_grid(series_of(values), [{}], ratio=0.5).first()
    # Validation days 4..7 are 5, 6, 7, 8 once interpolated.
    tm = [np.mean([1, 2, 3, 4]), np.mean([1, 2, 3, 4, 5]), np.mean([1, 2, 3, 4, 5])]
    sw = [None, None, None, 1.0]
    tm.append(np.mean([1, 2, 3, 4, 5]))
    pred = [t if s is None else 0.45 * t + 0.55 * s for t, s in zip(tm, sw)]
    assert out.mae == pytest.approx(np.mean(np.abs(np.array([5, 6, 7, 8]) - pred)))


def test_keyed_window_frames_do_not_mix(spark):
    _, df = panel_of(spark, 8)
    keyed = df.withColumn("k", F.lit("a")).unionByName(df.withColumn("k", F.lit("b")))
    out = windows.sliding_windows(keyed, window=3, keys=["k"])
    assert out.count() == 10
    assert set(column(out.select("k", "created", F.size("X").alias("s")), "s")) == {3}


def test_backtest_without_history(series_of):
    # Validation starts on day 60; nothing was seen in the eight weeks before day 100.
    values = [1.0] + [...] * 99 + [5.0] + [...] * 10 + [2.0]
    loose = baseline.baseline_backtest(series_of(values), ratio=0.45).orderBy("created").collect()
    assert [r.y_pred for r in loose] == [None, None]
    with pytest.raises(Exception, match="not enough history"):
        baseline.baseline_backtest(series_of(values), ratio=0.45, strict=True).collect()


def test_pooled_grid_weighs_every_day(spark, series_of):
    a, b = series_of(range(40)), series_of([7.0] * 20)
    keyed = a.withColumn("k", F.lit("a")).unionByName(b.withColumn("k", F.lit("b")))
    single = {r.k: r.mae for r in baseline.baseline_grid(keyed, [{}], ["k"], ratio=0.5).collect()}
    pooled = baseline.baseline_grid(keyed, [{}], ["k"], ratio=0.5, pooled=True).collect()
    assert len(pooled) == 1
    assert pooled[0].mae == pytest.approx((20 * single["a"] + 10 * single["b"]) / 30)


def test_windows_touching_an_infinity_drop(spark):
    _, df = panel_of(spark, 12)
    broken = df.withColumn(
        "adSpend", F.when(F.col("created") == "2024-01-05", float("inf")).otherwise(F.col("adSpend"))
    )
    framed = windows.sliding_windows(broken, window=3)
    # Targets of 5 January (finite) to 12 January, minus the three windows holding the 5th.
    assert [str(d)[-2:] for d in column(framed, "created")] == ["04", "05", "09", "10", "11", "12"]
    assert framed.schema["X"].metadata["finite"]

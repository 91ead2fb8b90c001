import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import column, day
from dayloom.operators import calendar, covariates, features, split


def test_dedup_and_calendar(spark):
    rows = [(day(1), 1, 1.0), (day(2), 2, 2.0), (day(5), 3, 3.0), (day(5), 4, 4.0), (day(9), 5, 5.0)]
    df = spark.createDataFrame(rows, "created date, seq int, v double")
    single = calendar.dedup_keep_last(df, [], ["seq"])
    assert column(single, "v") == [1.0, 2.0, 4.0, 5.0]
    full = calendar.complete_calendar(single)
    assert column(full, "created") == [day(i) for i in range(1, 10)]
    assert column(full, "v") == [1.0, 2.0, None, None, 4.0, None, None, None, 5.0]


def test_calendar_per_key_and_empty(spark):
    rows = [("a", day(0), 1), ("a", day(2), 2), ("b", day(5), 3)]
    df = spark.createDataFrame(rows, "k string, created date, v int")
    out = calendar.complete_calendar(df, ["k"]).groupBy("k").count()
    assert {r.k: r["count"] for r in out.collect()} == {"a": 3, "b": 1}
    assert calendar.complete_calendar(df.limit(0), ["k"]).count() == 0


def test_trim_last_day(spark, series_of):
    assert column(calendar.trim_last_day(series_of([1, 2, 3])), "y") == [1.0, 2.0]
    assert calendar.trim_last_day(series_of([])).count() == 0
    undated = series_of([1, 2]).unionByName(
        spark.createDataFrame([(None, 9.0)], "created date, y double")
    )
    assert column(calendar.trim_last_day(undated), "y") == [1.0, 2.0]
    assert column(calendar.drop_open_day(series_of([1, 2, 3])), "y") == [1.0, 2.0]
    with pytest.raises(Exception, match="at least two days"):
        calendar.drop_open_day(series_of([1])).collect()


def test_target_series_keeps_gaps_null(spark):
    rows = [(day(0), "1"), (day(0), "2"), (day(2), "x"), (day(3), "4"), (None, "5")]
    df = spark.createDataFrame(rows, "created date, orders string")
    assert column(calendar.target_series(df, "orders"), "y") == [3.0, None, None, 4.0]
    assert column(calendar.target_series(df, "orders", complete=False), "y") == [3.0, 4.0]


@pytest.mark.parametrize(
    "values",
    [[None, 1, None, None, 7, None], [1, 2, 3], [None, None, 4], [5, None], [None, None]],
)
def test_interpolation_like_pandas(series_of, values):
    index = pd.date_range("2024-01-01", periods=len(values))
    want = pd.Series(values, index, dtype=float)
    want = want.interpolate(method="time", limit_direction="both").ffill().bfill()
    got = column(calendar.interpolate_linear(series_of(values)), "y")
    assert [math.nan if g is None else g for g in got] == pytest.approx(list(want), nan_ok=True)


def test_fill_both_ways(series_of):
    assert column(calendar.fill_both_ways(series_of([None, 1, None, 3, None]), "y"), "y") == [
        1.0, 1.0, 1.0, 3.0, 3.0,
    ]
    assert column(calendar.fill_both_ways(series_of([None, None]), "y"), "y") == [0.0, 0.0]


def test_impute(series_of):
    data = series_of([1, None, 3, 10]).withColumn("z", F.lit(None).cast("double"))
    median = features.impute(data, ["y", "z"], indicators=True).orderBy("created").collect()
    assert [r.y for r in median] == [1.0, 3.0, 3.0, 10.0]
    assert [r.y_was_missing for r in median] == [0, 1, 0, 0]
    assert {r.z for r in median} == {0.0}
    assert column(features.impute(data, ["y"], strategy="mean"), "y")[1] == pytest.approx(14 / 3)
    early = features.impute(data, ["y"], fit_until="2024-01-03")
    assert column(early, "y")[1] == 2.0
    with pytest.raises(ValueError):
        features.impute(data, ["y"], strategy="mode")


def test_growth_on_zero_base(series_of):
    data = series_of([1, 2, 0, 5, 0, 0]).withColumnRenamed("y", "totalRevenue")
    grown = features.add_growth(data)
    assert column(grown, "revenue_growth") == [None, 1.0, -1.0, None, -1.0, None]
    assert "investment_growth" not in grown.columns
    pct = features.pct_change(data, "totalRevenue")
    assert column(pct, "totalRevenue_pct_change") == [100.0, -100.0, -100.0]


@pytest.mark.parametrize("window,center", [(4, True), (7, True), (3, False), (1, True)])
def test_rolling_mean_like_pandas(series_of, window, center):
    values = [3, 4, 8, 2, 9, 1, 7, 7, 3, 12]
    pct = pd.Series(values, dtype=float).pct_change().dropna() * 100
    want = pct.rolling(window, center=center, min_periods=1).mean()
    out = features.pct_change_smoothed(series_of(values), "y", window=window, center=center)
    assert column(out, f"y_pct_change_ma{window}") == pytest.approx(list(want))


def test_lags_and_lead(spark):
    rows = [(day(i), i, float(i), i % 2) for i in range(4)]
    df = spark.createDataFrame(rows, "created date, orders int, adSpend double, event_start int")
    out = features.add_event_lead(features.add_lags(df, [2, 1, 2, -3, 0]))
    assert [c for c in out.columns if "_lag_" in c] == [
        "adSpend_lag_1", "orders_lag_1", "adSpend_lag_2", "orders_lag_2",
    ]
    assert column(out, "orders_lag_2") == [None, None, 0, 1]
    assert column(out, "event_start_next_1") == [1.0, 0.0, 1.0, 0.0]


def pandas_panel(pdf):
    """The panel rules restated in pandas for one series."""
    pdf = pdf.set_index("created").sort_index().astype(float)
    pdf = pdf.reindex(pd.date_range(pdf.index.min(), pdf.index.max()))
    days = pdf.index
    pdf["created_weekday_sin"] = np.sin(2 * np.pi * days.dayofweek / 7)
    pdf["created_month_cos"] = np.cos(2 * np.pi * days.month / 12)
    pdf = pdf.fillna(pdf.median()).fillna(0)
    for k in (1, 7, 30):
        pdf[f"adSpend_lag_{k}"] = pdf["adSpend"].shift(k)
        pdf[f"orders_lag_{k}"] = pdf["orders"].shift(k)
    with np.errstate(all="ignore"):
        pdf["revenue_growth"] = pdf["totalRevenue"] / pdf["totalRevenue"].shift(1) - 1
        pdf["investment_growth"] = pdf["adSpend"] / pdf["adSpend"].shift(1) - 1
    pdf["event_start"] = np.floor(pdf["event_start"])
    pdf["event_start_next_1"] = pdf["event_start"].shift(-1).fillna(0)
    pdf = pdf.replace([np.inf, -np.inf], np.nan)
    rest = [c for c in pdf.columns if c != "orders"]
    pdf[rest] = pdf[rest].fillna(pdf[rest].median()).fillna(0)
    return pdf


def test_panel_like_pandas(spark):
    rng = np.random.default_rng(5)
    keep = sorted(rng.choice(60, 45, replace=False))
    pdf = pd.DataFrame(
        {
            "created": [pd.Timestamp("2024-01-01") + pd.Timedelta(days=int(i)) for i in keep],
            "orders": rng.integers(0, 9, 45).astype(float),
            "adSpend": np.where(rng.random(45) < 0.2, np.nan, rng.integers(0, 5, 45)),
            "totalRevenue": rng.integers(0, 3, 45).astype(float),
            "event_start": rng.integers(0, 2, 45).astype(float),
        }
    )
    source = spark.createDataFrame(pdf).withColumn("created", F.to_date("created"))
    got = features.feature_panel(source).orderBy("created").toPandas()
    want = pandas_panel(pdf)
    assert len(got) == len(want)
    for c in want.columns:
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), abs=1e-9), c


@pytest.mark.parametrize("n,ratio", [(10, 0.9), (10, 0.2), (7, 0.5), (1, 0.5), (365, 0.1)])
def test_split_size(series_of, n, ratio):
    parts = split.time_split(series_of(range(n)), ratio)
    assert parts.filter("split = 'train'").count() == int(n * (1 - ratio))


def test_split_rejects_ratio(series_of):
    for ratio in (0.0, 1.0, -1, 2):
        with pytest.raises(ValueError):
            split.time_split(series_of([1, 2]), ratio)


def test_split_then_interpolate(series_of):
    out = split.interpolate_split(series_of([1, None, None, None, 9, 9]), 0.5)
    assert column(out, "y") == [1.0, 1.0, 1.0, 9.0, 9.0, 9.0]


def test_covariates_and_model_frame(spark):
    rows = [(day(0), 4.0, 1.0, 0), (day(0), 1.0, 2.0, 1), (day(3), 5.0, None, 1)]
    df = spark.createDataFrame(rows, "created date, orders double, adSpend double, event_start int")
    cov = covariates.known_covariates(df).orderBy("created").collect()
    assert [(r.adSpend, r.event_start) for r in cov] == [(3.0, 1.0), (0.0, 1.0)]
    bare = covariates.known_covariates(df.select("created")).collect()
    assert {(r.adSpend, r.event_start) for r in bare} == {(0.0, 0.0)}
    frame = covariates.model_frame(df, "orders").orderBy("created").collect()
    assert [r.orders for r in frame] == [5.0, 5.0, 5.0, 5.0]
    assert [r.time_idx for r in frame] == [0, 1, 2, 3]
    assert [r.event_start_next_1 for r in frame] == [0.0, 0.0, 1.0, 0.0]
    assert (frame[0].month, frame[0].weekday, frame[0].series_id) == ("1", "0", "main")
    parts = covariates.model_frame(df, "orders", ratio=0.5)
    assert parts.count() == 4


def test_spend_scale(spark):
    rows = [(i, float(v)) for i, v in enumerate([0, 3, 8, 100])]
    df = spark.createDataFrame(rows, "time_idx int, adSpend double")
    logged = np.log1p([0, 3, 8])
    scale = covariates.ad_spend_scale(df, cutoff=2)
    row = scale.first()
    assert row.log_mean == pytest.approx(logged.mean())
    assert row.log_std == pytest.approx(logged.std(ddof=1))
    scaled = covariates.scale_ad_spend(df, scale)
    assert column(scaled, "adSpend", "time_idx")[3] == pytest.approx(
        (np.log1p(100) - logged.mean()) / logged.std(ddof=1)
    )
    packed = scaled.withColumn("s", scale.select(F.struct("*")).scalar())
    back = packed.select(
        "time_idx", covariates.unscale_ad_spend(F.col("adSpend"), F.col("s")).alias("v")
    )
    assert column(back, "v", "time_idx") == pytest.approx([0, 3, 8, 100])
    assert covariates.ad_spend_scale(df, cutoff=0).first().log_std == 1.0

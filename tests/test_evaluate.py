import math
import os

import numpy as np
import pytest

from conftest import column, day
from dayloom.operators import evaluate, importance

ROWS = [
    ("m", 0, 10.0, 8.0, day(0)),
    ("m", 1, 0.0, 1.0, day(2)),
    ("m", 2, 5.0, None, day(3)),
    ("m", 3, -4.0, -4.0, day(4)),
    ("n", 0, 2.0, 3.0, day(0)),
]


def errors(spark):
    df = spark.createDataFrame(
        ROWS, "model string, sample_idx bigint, y_true double, y_pred double, created date"
    )
    return evaluate.error_rows(df, df["model"])


def test_error_rows_keep_index_gaps(spark):
    rows = errors(spark).filter("model = 'm'").orderBy("sample_idx").collect()
    assert [r.sample_idx for r in rows] == [0, 1, 3]
    assert rows[0].mape == pytest.approx(0.2)
    assert rows[1].mape == pytest.approx(1 / 1e-8)
    assert rows[2].mape == 0.0


def test_metrics(spark):
    row = {r.model: r for r in evaluate.metrics_by_model(errors(spark)).collect()}["m"]
    assert row.mae == pytest.approx(1.0)
    assert row.rmse == pytest.approx(math.sqrt(5 / 3))
    assert row.n == 3


def test_metric_values_scale_proportions(spark):
    df = spark.createDataFrame(
        [("A", "0.5"), ("A", "1.5"), ("B", "0.5"), ("B", "3"), ("B", "x")], "model string, mape string"
    )
    got = {(r.model, r.value) for r in evaluate.metric_values(df).collect()}
    assert got == {("A", 50.0), ("A", 150.0), ("B", 0.5), ("B", 3.0)}
    only = evaluate.metric_values(df, models=["a"])
    assert {r.model for r in only.collect()} == {"A"}


@pytest.mark.parametrize("kind,want", [("AE", [0.0, 1.0, 2.0]), ("rmse", [0.0, 1.0, 4.0])])
def test_error_values(spark, kind, want):
    out = evaluate.error_values(errors(spark), kind, models=["M"])
    assert sorted(r.value for r in out.collect()) == want
    assert evaluate.shared_range("sq_error") == (0.0, 9.6e6)
    assert evaluate.shared_range("ae") is None


def values_frame(spark, values, model="m"):
    return spark.createDataFrame([(model, float(v)) for v in values], "model string, value double")


@pytest.mark.parametrize("limits", [None, (0.0, 10.0)])
def test_histogram_like_numpy(spark, limits):
    values = [0, 0.5, 1, 9.99, 10, 3, 3, 7.5, 12 if limits else 2]
    out = evaluate.histogram(values_frame(spark, values), bins=5, limits=limits, models=["m"])
    counts, edges = np.histogram(values, bins=5, range=limits)
    rows = out.orderBy("bin").collect()
    assert [r.n for r in rows] == list(counts)
    assert [r.low for r in rows] == pytest.approx(list(edges[:-1]))


def test_histogram_of_equal_values(spark):
    rows = evaluate.histogram(values_frame(spark, [4, 4, 4]), bins=4).orderBy("bin").collect()
    assert sum(r.n for r in rows) == 3
    assert (rows[0].low, rows[-1].high) == (3.5, 4.5)


def test_histogram_with_nothing_in_range(spark):
    rows = evaluate.histogram(values_frame(spark, [50, 60]), bins=3, limits=(0.0, 1.0)).collect()
    assert [r.n for r in rows] == [0, 0, 0]


@pytest.mark.parametrize("limits", [None, (-2.0, 30.0)])
def test_density_like_the_formula(spark, limits):
    values = np.array([0.0, 1.0, 1.0, 4.0, 9.0, 2.5, 20.0])
    n = len(values)
    h = values.std(ddof=1) * n ** (-1 / 5)
    low, high = limits or (values.min(), values.max())
    x = np.linspace(low, high, 200)
    z = (x[:, None] - values) / h
    want = np.exp(-z * z / 2).sum(axis=1) / (h * np.sqrt(2 * np.pi)) * (high - low) / 60
    out = evaluate.density(values_frame(spark, values), limits=limits).orderBy("point").collect()
    assert [r.x for r in out] == pytest.approx(list(x))
    assert [r.y for r in out] == pytest.approx(list(want))


def test_density_needs_spread(spark):
    assert evaluate.density(values_frame(spark, [3, 3, 3])).count() == 0
    assert evaluate.density(values_frame(spark, [3])).count() == 0


def test_density_with_far_outlier_is_complete(spark):
    values = np.array([0.0] * 50 + [0.1] * 50 + [1e6])
    h = values.std(ddof=1) * len(values) ** (-1 / 5)
    x = np.linspace(0, 1e6, 200)
    z = (x[:, None] - values) / h
    want = np.exp(-z * z / 2).sum(axis=1) / (h * np.sqrt(2 * np.pi)) * 1e6 / 60
    out = {r.point: r.y for r in evaluate.density(values_frame(spark, values)).collect()}
    assert [out.get(i, 0.0) for i in range(200)] == pytest.approx(list(want))


def test_true_vs_pred(spark):
    rows = evaluate.true_vs_pred(errors(spark), "M").orderBy("x").collect()
    assert [r.x for r in rows] == [0.0, 2.0, 4.0]
    assert rows[0].mape_pct == pytest.approx(100 * np.mean([0.2, 1e8, 0.0]))
    undated = evaluate.true_vs_pred(errors(spark).drop("created"), "m").orderBy("x")
    assert column(undated, "x", "x") == [0.0, 1.0, 2.0]


def test_true_vs_pred_of_one_product(spark):
    df = spark.createDataFrame(
        [("m", "7", 0, 1.0, 2.0), ("m", "8", 0, 1.0, 1.0)],
        "model string, product_id string, sample_idx int, y_true double, y_pred double",
    )
    rows = evaluate.true_vs_pred(df, "m", only={"product_id": "7", "absent": "x"}).collect()
    assert [r.y_pred for r in rows] == [2.0]


def test_mean_of(spark):
    df = spark.createDataFrame([("1",), ("x",), ("4",), (None,)], "y_true string")
    assert tuple(evaluate.mean_of(df).first()) == (2.5, 2)


def test_select_best(spark):
    schema = "model string, mae double, rmse double, error string"
    rows = [
        ("sarima", 1.0, 1.0, "failed"),
        ("lstm", float("nan"), 1.0, None),
        ("unknown", 0.1, 0.1, None),
        ("ridge", 2.0, 9.0, None),
        ("linear_regression", 2.0, 9.0, None),
        ("xgboost", 3.0, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    assert tuple(evaluate.select_best(df).first()) == ("linear_regression", "mae", 2.0)
    assert evaluate.select_best(df, "rmse").first().model_name == "lstm"
    assert evaluate.select_best(df.filter("model = 'unknown'")).count() == 0


def test_report_and_clipping(spark, series_of):
    events = spark.createDataFrame([(day(1),), (day(2),), (day(9),)], "startDate date")
    row = evaluate.series_report(series_of([1, 2, 3]), events).first()
    assert tuple(row) == (2, 2, 3, 1, 3)
    changes = spark.createDataFrame([(-150.0,), (0.0,), (100.0,), (101.0,)], "p double")
    assert evaluate.clipped_days(changes, "p").first().n_clipped == 2


# Published importances and their shares (percent) within three groups.
PUBLISHED = """static,orders_center,194.37501525878906,79.3367424660652
static,series_id,27.892553329467773,11.384715866258501
static,orders_scale,14.670092582702637,5.987793007437901
static,encoder_length,8.062334060668945,3.2907486602383957
encoder,orders,64.18740844726562,26.198942019412435
encoder,weekday,59.15303421020508,24.144095408037963
encoder,month,52.83306121826172,21.56451461508214
encoder,time_idx,21.93146324157715,8.951617579934119
encoder,adSpend,15.946712493896484,6.508862191734608
encoder,event_start,13.666793823242188,5.578283149732604
encoder,relative_time_idx,8.691728591918945,3.5476442956134697
encoder,event_start_next_1,8.589799880981445,3.5060407404526632
decoder,weekday,121.20417022705078,49.471089503454955
decoder,adSpend,34.990230560302734,14.28172664812262
decoder,time_idx,24.22726821899414,9.88868082872756
decoder,relative_time_idx,20.193893432617188,8.242405418532972
decoder,month,17.129180908203125,6.991502357081959
decoder,event_start,17.097566604614258,6.978598559799206
decoder,event_start_next_1,10.157691955566406,4.145996684280733"""


def test_published_importance_shares(spark):
    rows = [line.split(",") for line in PUBLISHED.split(os.linesep)]
    df = spark.createDataFrame(
        [(g, f, float(v), float(p)) for g, f, v, p in rows],
        "group string, feature string, importance double, want double",
    )
    for r in importance.share_within(df, "importance", ["group"]).collect():
        assert r.importance_pct == pytest.approx(r.want, abs=1e-10)
    top = importance.top_n_per_group(df, "importance", 1, ["group"])
    assert {r.feature for r in top.collect()} == {"orders_center", "orders", "weekday"}
    assert importance.top_n(df, "importance", 2).collect()[1].feature == "weekday"


def test_share_of_nothing(spark):
    df = spark.createDataFrame([("a", 0.0)], "g string, v double")
    assert importance.share_within(df, "v").first().v_pct == 0.0

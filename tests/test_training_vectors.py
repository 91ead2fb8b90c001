"""Halo blocks, ridge grids from one pass, pooled models and trees inside the fold."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from dayloom.operators import forecast, models, windows
from dayloom.operators.least_squares import normal_sums, ridge_scores
from dayloom.operators.split import flat_split
from dayloom.operators.trees import ensemble_value, node_arrays
from tests.conftest import day


@pytest.fixture(scope="module")
def rows(spark):
    """Four series of 0 to 400 days with gaps, NULLs, an infinity; one key is NULL."""
    rng = random.Random(4)
    out = []
    for key, n in (("a", 400), ("b", 90), (None, 60), ("d", 5)):
        for i in range(n):
            if rng.random() < 0.1:
                continue
            x = float("inf") if (key, i) == ("a", 150) else rng.uniform(-5, 5)
            z = None if rng.random() < 0.02 else rng.uniform(0, 1)
            out.append((key, day(i), x, z, float(i % 7) + (10 if key == "a" else 0)))
    return spark.createDataFrame(out, "k string, created date, x double, z double, orders double")


def listed(vectors):
    return sorted(
        (r["k"] or "", r["created"], r["split"], tuple(r["features"].toArray()), r["y"]) for r in vectors.collect()
    )


@pytest.mark.parametrize("block,window", [(256, 7), (5, 7), (3, 11), (1, 2), (64, 28)])
def test_halo_blocks_equal_whole_series(rows, block, window):
    want = flat_split(windows.sliding_windows(rows, ["x", "z", "orders"], window=window, keys=["k"]), 0.3, ["k"])
    got = windows.training_vectors(
        rows, ["x", "z", "orders"], window=window, ratio=0.3, keys=["k"], block_rows=block, tasks=3
    )
    assert listed(got) == listed(want)
    assert got.schema["features"].metadata["feature_columns"] == ["x", "z", "orders"]


def test_one_series_fills_several_tasks(rows):
    one = rows.filter("k = 'a'").drop("k")
    built = windows.training_vectors(one, ["x"], window=7, block_rows=32, tasks=4)
    sizes = [n for n in built.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    assert len(sizes) > 1
    assert built.count() == flat_split(windows.sliding_windows(one, ["x"], window=7), 0.2).count()
    assert windows.training_vectors(one.limit(0), ["x"], window=7).count() == 0


def test_row_numbers_over_many_ranges(rows):
    one = rows.filter("k = 'a'")
    numbered = windows.numbered_rows(one, ["k"], range_days=10).orderBy("created").collect()
    assert [r["_at"] for r in numbered] == list(range(len(numbered)))


def test_ridge_grid_in_one_pass_equals_single_fits(rows):
    vectors = windows.training_vectors(rows, ["x", "z", "orders"], window=7, keys=["k"], tasks=3)
    train, validation = models.prepared_windows(vectors, 0.2, ["k"])
    alphas = [0.1, 1.0, 5.0, 10.0]
    for alpha, (mae, rmse, mape) in zip(alphas, ridge_scores(train, validation, alphas), strict=True):
        fitted = models.fit_window_model("ridge", train, {"ridge_alpha": alpha})
        weights, bias = normal_sums(train).ridge(alpha)
        assert fitted.coefficients.toArray() == pytest.approx(weights, abs=1e-8)
        assert fitted.intercept == pytest.approx(bias, abs=1e-7)
        want = models._score(models.validation_errors("ridge", fitted, validation, ["k"]))
        assert (mae, rmse, mape) == pytest.approx(want, rel=1e-8)
    with pytest.raises(ValueError):
        normal_sums(train.limit(0)).ridge(1.0)
    grid = models.grid_search("ridge", {"ridge_alpha": [1.0, "x", -1, 5]}, windows=vectors, keys=["k"]).orderBy("run_id")
    assert [r.error is None for r in grid.collect()] == [True, False, False, True]


@pytest.fixture(scope="module")
def twins(spark):
    """Two series with the same history of x but different levels of the target."""
    rng = random.Random(1)
    xs = [rng.uniform(0, 1) for _ in range(120)]
    out = [(k, day(i), x, level + x) for k, level in (("low", 10.0), ("high", 50.0)) for i, x in enumerate(xs)]
    return spark.createDataFrame(out, "k string, created date, x double, orders double")


OPTIONS = {"random_forest_n_estimators": 5, "xgboost_n_estimators": 5, "ridge_alpha": 0.01}


@pytest.mark.parametrize("name", ["ridge", "random_forest", "xgboost"])
def test_pooled_models_know_their_series(twins, name, tmp_path):
    vectors = windows.training_vectors(twins, ["x"], window=3, keys=["k"])
    train, validation = models.prepared_windows(vectors, 0.2, ["k"])
    blind = models.fit_window_model(name, train, OPTIONS)
    knows = models.fit_window_model(name, train, OPTIONS, series=["k"])
    errors = [models._score(models.validation_errors(name, m, validation, ["k"]))[0] for m in (blind, knows)]
    assert errors[0] > 15 and errors[1] < (1 if name != "xgboost" else 20)
    assert knows.series_index.labels == ('["high"]', '["low"]') and knows.window == 3
    future = forecast.recursive_forecast(twins, knows, 3, ["k"])
    level = {r["k"]: r["p"] for r in future.groupBy("k").agg(F.avg("prediction").alias("p")).collect()}
    assert level["high"] - level["low"] > (30 if name != "xgboost" else 5)
    # A series the model has not met: every indicator 0, or the category of unseen ones.
    fresh = twins.filter("k = 'low'").withColumn("k", F.lit("new"))
    assert forecast.recursive_forecast(fresh, knows, 2, ["k"]).filter("prediction IS NULL").count() == 0
    with pytest.raises(ValueError, match="tells series apart"):
        forecast.recursive_forecast(twins.filter("k = 'low'").drop("k"), knows, 2)
    # The index is stored with the winner.
    found = models.Comparison(
        twins.sparkSession.createDataFrame([(name, 1.0, 1.0, 1.0, None)], models.METRIC_ROW), None, {name: knows}
    )
    models.promote(found, "orders", str(tmp_path))
    _, loaded = models.load_winner(twins.sparkSession, str(tmp_path))
    again = forecast.recursive_forecast(twins, loaded, 3, ["k"])
    key = lambda r: (r["k"], r["created"])
    pairs = zip(sorted(future.collect(), key=key), sorted(again.collect(), key=key), strict=True)
    assert all(a["prediction"] == pytest.approx(b["prediction"]) for a, b in pairs)


def test_too_many_series_in_one_model(twins, monkeypatch):
    monkeypatch.setattr(models, "MOST_SERIES", 1)
    vectors = windows.training_vectors(twins, ["x"], window=3, keys=["k"])
    with pytest.raises(ValueError, match="more than 1 series"):
        models.fit_window_model("ridge", models.prepared_windows(vectors, 0.2, ["k"])[0], series=["k"])


def test_comparison_keeps_order_side_by_side(twins):
    vectors = windows.training_vectors(twins, ["x"], window=3, keys=["k"])
    chosen = ("random_forest", "none", "ridge", "baseline_tm7_sw8_blend")
    for parallel in (1, 3):
        out = models.compare_models(
            vectors, twins, ["k"], models=chosen, options=OPTIONS, pooled=True, parallel=parallel
        )
        rows = out.metrics.collect()
        assert [r.model for r in rows] == list(chosen) and rows[1].error
        assert rows[0].mae < 5 and rows[2].mae < 1


@pytest.mark.parametrize("name", ["random_forest", "xgboost"])
@pytest.mark.parametrize("series", [(), ("k",)])
def test_node_arrays_predict_like_the_model(twins, name, series):
    vectors = windows.training_vectors(twins, ["x", "orders"], window=3, keys=["k"])
    train, validation = models.prepared_windows(vectors, 0.2, ["k"])
    model = models.fit_window_model(name, train, OPTIONS, series=series)
    spark = twins.sparkSession
    index = model.series_index
    ready = index.attach(validation, True) if index else validation
    from pyspark.ml.functions import vector_to_array

    trees = node_arrays(spark, model)
    scored = model.transform(ready).withColumn("_t", trees.scalar())
    own = scored.select("prediction", ensemble_value(model, F.col("_t"), vector_to_array("features")).alias("own"))
    for r in own.collect():
        assert r["own"] == pytest.approx(r["prediction"], rel=1e-12)


def test_long_tree_forecast_in_one_job_equals_single_steps(twins):
    one = twins.filter("k = 'low'").drop("k")
    train, _ = models.prepared_windows(windows.training_vectors(one, ["x", "orders"], window=3), 0.2)
    model = models.fit_window_model("random_forest", train, OPTIONS)
    got = forecast.recursive_forecast(one, model, 365).orderBy("created").collect()
    assert len(got) == 365 and got[-1]["created"] == day(119) + dt.timedelta(days=365)
    last = one.orderBy("created").collect()[-3:]
    seen = [[r["x"], r["orders"]] for r in last]
    for r in got[:20]:
        row = list(seen[-1])  # the future day itself, carried
        p = model.predict(Vectors.dense(np.array([*seen[-2:], row]).ravel()))
        assert r["prediction"] == pytest.approx(p, rel=1e-12)
        seen.append([row[0], p])

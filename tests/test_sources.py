import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from conftest import day
from dayloom.functions import clean_number, label_title, whole_number
from dayloom.operators import items
from dayloom.schemas import AD_SPENDS, PREDICTION_ERRORS
from dayloom.sources import files, overrides, tables


def test_numbers_from_junk(spark):
    texts = ["abc", "3.5", "NaN", "Infinity", "-7", None, " 2 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    rows = df.select("i", clean_number("c").alias("n"), whole_number("c").alias("w")).orderBy("i")
    got = [(r.n, r.w) for r in rows.collect()]
    assert got == [(None, 0), (3.5, 3), (None, 0), (None, 0), (-7.0, -7), (None, 0), (2.0, 2)]


def test_ad_spends_are_typed_and_filtered(spark):
    rows = [
        ("2022-12-31", "1", "2", "3", "4", "5", "6"),
        ("2023-01-01", "1.5", None, "x", "4.9", "5", None),
    ]
    names = ["date", *[f.name for f in AD_SPENDS.fields[1:]]]
    df = spark.createDataFrame(rows, names).withColumn("date", F.to_date("date"))
    out = tables.scan_ad_spends(df)
    assert [f.dataType for f in out.schema] == [f.dataType for f in AD_SPENDS]
    assert [tuple(r) for r in out.collect()] == [
        (dt.date(2023, 1, 1), 1.5, 0.0, 0.0, 4, 5, 0)
    ]
    profile = tables.profile_ad_spends(df).orderBy("date").collect()
    assert profile[1]["rcRevenue"] is None and profile[1]["totalRevenue"] is None


def test_event_days(spark):
    raw = ["2024-03-01", "bad", None, "2024-03-01T10:00:00", "2024-02-01", "2020-01-01"]
    df = spark.createDataFrame([(r,) for r in raw], "startDate string")
    got = sorted(r.startDate for r in tables.scan_event_days(df).collect())
    assert got == [dt.date(2024, 2, 1), dt.date(2024, 3, 1)]
    series = spark.createDataFrame([(dt.date(2024, 2, 1),), (dt.date(2024, 2, 9),)], "created date")
    days = tables.scan_event_days(df, since=None)
    assert [r.startDate for r in tables.events_between(days, series).collect()] == [
        dt.date(2024, 2, 1)
    ]


ITEM_TEXTS = [
    (1, '[{"productId": 3, "title": "a", "quantity": 2}, {"productId": "x"}, 5, "s"]'),
    (2, '{"productId": 4, "quantity": "bad"}'),
    (3, "17"),
    (4, None),
    (5, "[]"),
    (6, '"text"'),
]


def test_item_shapes(spark):
    df = spark.createDataFrame(ITEM_TEXTS, "id int, line_items string").withColumn(
        "created", F.lit("2024-01-01").cast("timestamp")
    )
    lines = tables.scan_order_lines(df)
    rows = lines.orderBy("id", "productId").collect()
    assert [(r.id, r.productId, r.title, r.quantity) for r in rows] == [
        (1, "3", "a", "2"),
        (1, "x", None, None),
        (2, "4", None, "bad"),
    ]
    assert rows[0].created_weekday == 0 and rows[0].created_month == 1
    numbers = items.item_numbers(lines).orderBy("id", "productId").collect()
    assert [(r.productId, r.quantity) for r in numbers] == [(0, 0), (3, 2), (4, 0)]
    labels = items.item_labels(lines).orderBy("id", "productId").collect()
    assert [(r.product_label, r.quantity) for r in labels] == [("a", 2.0), ("x", 0.0), ("4", 0.0)]


def test_nested_structs_explode_and_old_orders_drop(spark):
    df = spark.sql(
        """SELECT 1 AS id, timestamp'2024-01-02 10:00:00' AS created,
             array(named_struct('productId', 7, 'quantity', 2)) AS line_items
           UNION ALL SELECT 2, timestamp'2024-01-02 11:00:00', array()
           UNION ALL SELECT 3, timestamp'2019-01-01 00:00:00',
             array(named_struct('productId', 7, 'quantity', 2))"""
    )
    rows = tables.scan_order_lines(df).collect()
    assert [(r.id, r.productId, r.title, str(r.created)) for r in rows] == [
        (1, 7, None, "2024-01-02")
    ]


@pytest.mark.parametrize(
    "scale,shift", [(1000, 0), (1, 0), (1_000_000_000, -1_600_000_000)]
)
def test_epoch_units(spark, scale, shift):
    seconds = [1_700_000_000, 1_700_086_400, 1_700_172_800]
    rows = [((s + shift) * scale if shift == 0 else s % 1000,) for s in seconds]
    out = items.normalize_created(spark.createDataFrame(rows, "created bigint"))
    years = {r.created.year for r in out.collect()}
    assert years == ({2023} if shift == 0 else {1970})


def test_epoch_median_between_two_values(spark):
    # Two values straddling 1e12: the median is their mean.
    low = spark.createDataFrame([(10,), (1_500_000_000_000,)], "created bigint")
    high = spark.createDataFrame([(10,), (2_100_000_000_000,)], "created bigint")
    assert max(r.created.year for r in items.normalize_created(high).collect()) == 2036
    assert max(r.created_dt.year for r in items.normalize_created(
        low.filter("created < 100")).collect()) == 1970
    texts = spark.createDataFrame([("2024-05-06T07:00:00",), ("junk",)], "created string")
    got = {str(r.created) for r in items.normalize_created(texts).collect()}
    assert got == {"2024-05-06", "None"}


def test_history_before(spark):
    rows = [(day(i), None if i == 3 else float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "date date, totalRevenue double")
    got = tables.history_before(df, "2024-01-08", limit=4).orderBy("date").collect()
    assert [r.totalRevenue for r in got] == [2.0, 4.0, 5.0, 6.0]


def test_overrides_last_duplicate_wins(spark):
    text = json.dumps(
        [
            {"date": "2026-06-01", "value": 1},
            {"date": "2026-06-02T11:00:00Z", "value": "2.5"},
            {"date": "2026-06-01", "value": 3},
        ]
    )
    got = overrides.overrides_from_text(spark, text, "future_ad_spend")
    assert sorted((str(r.created), r.value) for r in got.collect()) == [
        ("2026-06-01", 3.0),
        ("2026-06-02", 2.5),
    ]
    for blank in (None, "", "  ", "null", "[]"):
        assert overrides.overrides_from_text(spark, blank, "x") is None


@pytest.mark.parametrize(
    "text",
    [
        '{"date": "2026-06-01", "value": 1}',
        '[{"date": "nope", "value": 1}]',
        '[{"date": "2026-06-01", "value": "Infinity"}]',
        '[{"date": "2026-06-01"}]',
        "not json",
    ],
)
def test_overrides_reject(spark, text):
    with pytest.raises(Exception):
        overrides.overrides_from_text(spark, text, "x").collect()
    loose = overrides.parse_overrides(
        spark.createDataFrame([(text,)], "x string"), "x", strict=False
    )
    assert loose.collect() == [] or text.startswith("{")


def test_future_covariates_carry_and_flag(spark):
    last = spark.createDataFrame([(day(0), 10.0)], "created date, adSpend double")
    spend = spark.createDataFrame([(day(2), 50.0)], "created date, value double")
    events = spark.createDataFrame([(day(3), 0.5), (day(1), 0.4)], "created date, value double")
    rows = overrides.future_covariates(last, 4, ad_spend=spend, events=events)
    got = [
        (r.adSpend, r.event_start, r.event_start_next_1) for r in rows.orderBy("created").collect()
    ]
    assert got == [(10.0, 0.0, 0.0), (50.0, 0.0, 1.0), (50.0, 1.0, 0.0), (50.0, 0.0, 0.0)]


def test_dataset_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("m", 0, 1.0, 2.0, 1.0, day(0)), ("m", 1, 1.0, None, None, None)], PREDICTION_ERRORS
    )
    paths = files.write_datasets({"errors": df}, str(tmp_path), "both")["errors"]
    assert set(paths) == {"jsonl", "csv"}
    again = files.read_json_lines(spark, paths["jsonl"], PREDICTION_ERRORS)
    assert sorted(again.collect(), key=str) == sorted(df.collect(), key=str)
    csv = files.read_metrics(spark, paths["csv"], PREDICTION_ERRORS)
    assert csv.count() == 2
    files.write_dataset(df, str(tmp_path), "errors", "parquet")
    files.write_dataset(df.limit(1), str(tmp_path), "errors", "parquet")
    assert spark.read.parquet(f"{tmp_path}/errors.parquet").count() == 1
    with pytest.raises(ValueError):
        files.write_dataset(df, str(tmp_path), "x", "xml")


def test_metric_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        json.dumps(
            {"ridge": {"mae": 1.0, "rmse": 2.0, "mape": 0.1}, "lstm": {"error": "missing"}}
        )
    )
    rows = files.read_metrics(spark, str(tmp_path / "m.json")).collect()
    assert [tuple(r) for r in rows] == [("ridge", 1.0, 2.0, 0.1)]
    (tmp_path / "l.json").write_text(json.dumps([{"model": "a", "mae": 1}, {"model": "b"}]))
    assert files.read_metrics(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "one.json").write_text(json.dumps({"mae": 1.0, "rmse": 2.0, "mape": 0.5}))
    assert files.read_metrics(spark, str(tmp_path / "one.json")).first()["mae"] == 1.0
    (tmp_path / "m.csv").write_text("model,mae\nridge,1.5\n")
    assert files.read_metrics(spark, str(tmp_path / "m.csv")).first()["mae"] == 1.5
    with pytest.raises(ValueError):
        files.read_metrics(spark, str(tmp_path / "m.txt"))


def test_windows_round_trip_keeps_only_finite(spark, tmp_path):
    rows = [
        ([[1.0, 2.0]], 1.0),
        ([[1.0, math.inf]], 1.0),
        ([[1.0, None]], 1.0),
        ([[1.0, 2.0]], math.nan),
    ]
    df = spark.createDataFrame(rows, "X array<array<double>>, y double")
    path = files.write_windows(df, str(tmp_path / "w"), ["a", "b"])
    back, features = files.read_windows(spark, path)
    assert features == ["a", "b"] and back.count() == 1


def test_label_title(spark):
    df = spark.createDataFrame([("random_forest",)], "m string")
    assert df.select(label_title("m")).first()[0] == "Random Forest"


def test_read_table_by_format(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert tables.read_table(spark, str(tmp_path / "p")).count() == 3
    spark.range(2).write.json(str(tmp_path / "j"))
    assert tables.read_table(spark, str(tmp_path / "j"), format="json").count() == 2

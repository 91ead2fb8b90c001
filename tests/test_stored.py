"""Streams of customers, stored layouts, day sketches and grids as rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dayloom.operators.daily import daily_new_customers, daily_unique_customers
from dayloom.operators.grids import grid_rows
from dayloom.operators.sketches import customer_sketches, customers_between, error_bound
from dayloom.sources import layout
from dayloom.streaming import closed_days as closed
from tests.conftest import day

SCHEMA = "ts timestamp, customerId string"
BEGIN = dt.datetime(2024, 1, 1)


def visits(seed, days, number):
    """Visits of few customers in order of time, some without one."""
    rng = random.Random(seed)
    times = sorted(rng.uniform(0, days * 86400) for _ in range(number))
    return [(BEGIN + dt.timedelta(seconds=t), rng.choice([None, *"abcdefghijklmnop"][: 2 + int(t / 20000)])) for t in times]


def write_part(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, out, path, state):
    query = closed.write_closed_days(out, path, state)
    query.awaitTermination()
    return query


def batch(spark, rows):
    lines = spark.createDataFrame(rows, SCHEMA).withColumn("created", F.to_date("ts"))
    first = lines.groupBy("customerId").agg(F.min("created").alias("_first"))
    return lines.join(first, "customerId", "left").withColumn("new", F.col("created") == F.col("_first"))


def test_customers_of_closed_days_over_a_restart(spark, tmp_path):
    rows = visits(1, 6, 900)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    total, reported = [], []
    for part in (rows[:300], rows[300:550], rows[550:]):  # the query ends and starts again in between
        write_part(spark, source, part)
        total += part
        drain(spark, closed.closed_day_customers(stream_of(spark, source), "ts", "customerId"), out, state)
        got = {r["created"]: r["unique_customers"] for r in spark.read.parquet(out).collect()}
        last = max(t for t, _ in total) - dt.timedelta(hours=1)
        want = {r["created"]: r["unique_customers"] for r in daily_unique_customers(batch(spark, total)).collect()}
        assert got == {d: n for d, n in want.items() if d < last.date()}
        reported.append(len(got))
    assert reported[0] < reported[1] < reported[2]


def test_days_of_nobody_and_late_rows(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_part(spark, source, [(BEGIN, None), (BEGIN + dt.timedelta(days=1), "a"), (BEGIN + dt.timedelta(days=3), "b")])
    out_of = closed.closed_day_customers(stream_of(spark, source), "ts", "customerId")
    assert closed.late_rows(drain(spark, out_of, out, state)) == 0
    got = {r["created"]: r["unique_customers"] for r in spark.read.parquet(out).collect()}
    assert got == {day(0): 0, day(1): 1}
    write_part(spark, source, [(BEGIN + dt.timedelta(hours=2), "late"), (BEGIN + dt.timedelta(days=4, hours=2), "c")])
    again = drain(spark, closed.closed_day_customers(stream_of(spark, source), "ts", "customerId"), out, state)
    assert closed.late_rows(again) == 1
    rows = spark.read.parquet(out).collect()
    assert {r["created"]: r["unique_customers"] for r in rows} == got | {day(3): 1} and len(rows) == 3


def test_new_customers_over_a_restart(spark, tmp_path):
    rows = visits(2, 6, 400)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    total = []
    for part in (rows[:150], rows[150:]):
        write_part(spark, source, part)
        total += part
        drain(spark, closed.first_seen_customers(stream_of(spark, source), "ts", "customerId"), out, state)
        seen = spark.read.parquet(out)
        assert seen.count() == seen.select("customerId").distinct().count()
        got = {r["created"]: r["n"] for r in seen.groupBy("created").agg(F.count("*").alias("n")).collect()}
        want = daily_new_customers(batch(spark, total), first_order=F.col("new")).collect()
        last = max(t for t, _ in total) - dt.timedelta(hours=1)
        assert got == {r["created"]: r["new_customers"] for r in want if r["created"] < last.date()}


def test_a_forgotten_customer_is_new_again(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for d, who in ((0, "a"), (2, "b"), (9, "c"), (10, "a"), (20, "d")):
        write_part(spark, source, [(BEGIN + dt.timedelta(days=d), who)])
        query = closed.first_seen_customers(stream_of(spark, source), "ts", "customerId", remember_days=5)
        drain(spark, query, out, state)
    rows = sorted((r["customerId"], r["created"]) for r in spark.read.parquet(out).collect())
    assert rows == [("a", day(0)), ("a", day(10)), ("b", day(2)), ("c", day(9))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    orders = spark.range(500).select("id", F.expr("date_add(date'2024-01-01', int(id % 30))").alias("created"))
    lines = spark.range(2000).select((F.col("id") % 600).alias("id"), F.col("id").alias("productId"))
    for name, df in (("t_orders", orders), ("t_lines", lines)):
        layout.write_bucketed(df, name, "id", 4, str(tmp_path / name))
    try:
        joined = layout.joined_buckets(spark, "t_lines", "t_orders", "id")
        assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
        assert joined.count() == lines.join(orders, "id").count()
        assert layout.buckets_of(spark, "t_lines") == (4, ["id"])
        layout.write_bucketed(lines, "t_other", "id", 2, str(tmp_path / "other"))
        with pytest.raises(ValueError, match="bucketed alike"):
            layout.joined_buckets(spark, "t_other", "t_orders", "id")
    finally:
        for name in ("t_orders", "t_lines", "t_other"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("unit", ["day", "month"])
def test_ranges_of_days_read_their_folders_only(spark, tmp_path, unit):
    rows = spark.range(400).select("id", F.expr("date_add(date'2024-01-01', int(id % 100))").alias("created"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None)], "id long, created date"))
    path = layout.write_by_day(rows, str(tmp_path / "by"), unit=unit, files=2)
    found = layout.read_days(spark, path, "2024-02-10", "2024-02-20", unit=unit)
    assert f"created_{unit}" in plan_of(found).split("PartitionFilters")[1].split("]")[0]
    assert found.count() == 44 and set(found.columns) == {"id", "created"}
    folders = {f.split(f"created_{unit}=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(folders) <= 101 and layout.read_days(spark, path, unit=unit).count() == 401
    assert layout.read_days(spark, path, since="2024-04-05", unit=unit).count() == 4 * 5


def test_sketches_of_days_unite(spark):
    rng = random.Random(6)
    rows = [(day(rng.randrange(40)), rng.choice("xy"), rng.randrange(3000) if rng.random() > 0.05 else None) for _ in range(20_000)]
    lines = spark.createDataFrame(rows, "created date, k string, customerId long")
    sketches = customer_sketches(lines, ["k"])
    ranges = spark.createDataFrame(
        [("week", day(3), day(9)), ("all", day(0), day(60)), ("day", day(5), day(5)), ("none", day(90), day(99)), ("back", day(9), day(3))],
        "name string, first date, last date",
    )
    got = {(r["name"], r["k"]): r["unique_customers"] for r in customers_between(sketches, ranges, ["k"]).collect()}
    assert {n for n, _ in got} == {"week", "all", "day"}
    for (name, k), estimate in got.items():
        first, last = {"week": (3, 9), "all": (0, 60), "day": (5, 5)}[name]
        exact = len({c for d, kk, c in rows if kk == k and c is not None and day(first) <= d <= day(last)})
        assert abs(estimate - exact) <= max(1, error_bound() * exact)
    nobody = customer_sketches(spark.createDataFrame([(day(0), None)], "created date, customerId long"))
    assert customers_between(nobody, ranges).filter("name = 'all'").first()["unique_customers"] == 0


def test_grid_rows(spark):
    axes = {"b": spark.createDataFrame([(2,), (1,), (2,), (None,)], "v int"), "a": spark.createDataFrame([("y",), ("x",)], "v string")}
    rows = sorted(tuple(r) for r in grid_rows(axes).collect())
    assert rows == [(0, None, "x"), (1, None, "y"), (2, 1, "x"), (3, 1, "y"), (4, 2, "x"), (5, 2, "y")]
    with pytest.raises(ValueError):
        grid_rows({})
    with pytest.raises(Exception, match="candidates"):
        grid_rows(axes | {"c": spark.createDataFrame([], "v int")}).collect()

import datetime as dt

from pyspark.sql import functions as F

from conftest import column, day
from dayloom.operators import daily

LINES = "created date, customerId string, order_number_for_customer string, quantity double, product_label string"


def lines(spark):
    rows = [
        (day(0), "a", "1", 1.0, "p"),
        (day(0), "a", "1", 3.0, "q"),
        (day(0), "b", "2", 0.0, "p"),
        (day(0), None, None, 1.0, "p"),
        (day(2), "b", "bad", 5.0, "p"),
        (day(2), "c", "1", 1.0, "r"),
        (None, "z", "1", 9.0, "p"),
    ]
    return spark.createDataFrame(rows, LINES)


def test_counts_lines_not_orders(spark):
    out = daily.daily_counts(lines(spark))
    assert column(out, "orders") == [4, 2]
    weighted = spark.createDataFrame([(day(0), 3), (day(0), 2)], "created date, n int")
    assert column(daily.daily_counts(weighted, weight="n"), "orders") == [5]
    assert column(daily.daily_counts(weighted, weight=F.lit(1)), "orders") == [2]


def test_one_pass_stats_equal_the_single_operators(spark):
    stats = daily.daily_order_stats(lines(spark)).orderBy("created").collect()
    assert [
        (r.orders, r.unique_customers, r.new_customers, r.avg_order_number_for_customer)
        for r in stats
    ] == [(4, 2, 1, 4 / 3), (2, 2, 1, 1.0)]
    assert column(daily.daily_unique_customers(lines(spark)), "unique_customers") == [2, 2]
    assert column(daily.daily_new_customers(lines(spark)), "new_customers") == [1, 1]
    close = daily.daily_unique_customers(lines(spark), approximate=True)
    assert column(close, "unique_customers") == [2, 2]


def test_buckets_show_empty_ones(spark):
    weekdays = {r.created_weekday: r.orders for r in daily.orders_by_weekday(lines(spark)).collect()}
    assert weekdays == {0: 4, 1: 0, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0}
    months = {r.created_month: r.orders for r in daily.orders_by_month(lines(spark)).collect()}
    assert len(months) == 12 and months[1] == 6


def test_products(spark):
    units = daily.product_daily_units(lines(spark).dropna(subset=["created"]))
    matrix = {(r.created, r.product_label): r.quantity for r in daily.product_matrix(units).collect()}
    assert len(matrix) == 6
    assert matrix[(day(0), "r")] == 0.0 and matrix[(day(2), "p")] == 5.0
    wide = daily.product_pivot(units, ["p", "r"]).orderBy("created").collect()
    assert [(r.p, r.r) for r in wide] == [(2.0, 0.0), (5.0, 1.0)]
    launches = {r.product_label: r.launch_day for r in daily.product_launches(units).collect()}
    assert launches == {"p": day(0), "q": day(0)}
    assert daily.since_launch(units).count() == 3


def test_combined_outer_join(spark):
    spends = spark.createDataFrame(
        [(day(0), 1.0, 1.0, 1.0, 1, 1, 1), (day(1), 2.0, 2.0, 2.0, 2, 2, 2)],
        "date date, adSpend double, rcRevenue double, totalRevenue double, totalMerchSold bigint,"
        " totalNewCustomerBarsSold bigint, totalRecurringCustomerBarsSold bigint",
    )
    events = spark.createDataFrame([(day(1),), (day(1),), (day(9),), (None,)], "startDate date")
    stats = daily.daily_order_stats(lines(spark))
    rows = daily.combined_daily(stats, spends, events).orderBy("created").collect()
    assert [(r.created, r.orders, r.adSpend, r.unique_customers, r.event_start) for r in rows] == [
        (day(0), 4, 1.0, 2, 0),
        (day(1), 0, 2.0, 0, 1),
        (day(2), 2, None, 2, 0),
    ]
    assert [r.created_weekday for r in rows] == [0, 1, 2]
    plain = daily.combined_daily(stats, spends).collect()
    assert {r.event_start for r in plain} == {0}
    assert dt.date(2024, 1, 10) not in {r.created for r in plain}

"""Queries over streams, stored layouts, sketches and parameter grids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dayloom.operators import daily, items, sketches
from dayloom.operators.grids import grid_rows
from dayloom.plans import flows
from dayloom.plans import oracle as o
from dayloom.plans.catalog import query
from dayloom.plans.oracle import with_
from dayloom.session import staged_path
from dayloom.sources import layout
from dayloom.sources.retail import Retail
from dayloom.streaming import closed_days

DAY = "created"
SINCE, UNTIL = "1996-03-10", "1996-05-20"
_CLOSED = "CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 HOUR AS DATE) FROM events)"


def _event_stream(spark, folder):
    source = spark.read.parquet(f"{folder}/events.parquet")
    return (
        spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )


def _drained(spark, out):
    run = staged_path(spark, "closed-days")
    closed_days.write_closed_days(out, f"{run}/out", f"{run}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{run}/out")


@query(
    "closed_day_customers",
    f"""SELECT event_type, CAST(ts AS DATE) AS created, count(DISTINCT user_id) AS unique_customers
FROM events WHERE {_CLOSED} GROUP BY ALL""",
)
def closed_day_customers(spark, folder):
    stream = _event_stream(spark, folder)
    return _drained(spark, closed_days.closed_day_customers(stream, "ts", "user_id", ["event_type"]))


@query(
    "closed_day_new_customers",
    f"""SELECT created, count(*) AS new_customers FROM (
  SELECT user_id, min(CAST(ts AS DATE)) AS created FROM events GROUP BY 1)
WHERE created IN (SELECT CAST(ts AS DATE) FROM events WHERE {_CLOSED}) GROUP BY 1""",
)
def closed_day_new_customers(spark, folder):
    firsts = closed_days.first_seen_customers(_event_stream(spark, folder), "ts", "user_id")
    return _drained(spark, firsts).groupBy(DAY).agg(F.count(F.lit(1)).alias("new_customers"))


@query(
    "daily_orders_bucketed",
    with_(o.LINES, "SELECT created, count(*) AS orders FROM lines GROUP BY created"),
)
def daily_orders_bucketed(spark, folder):
    """Daily line counts from order and line tables stored in equal buckets of the order id."""
    retail = Retail(spark, folder)
    mark = uuid.uuid4().hex
    names = [f"dayloom_orders_{mark}", f"dayloom_lines_{mark}"]
    lines = retail.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("productId"))
    for name, rows in zip(names, (retail.orders().select("id", DAY), lines), strict=True):
        layout.write_bucketed(rows, name, "id", 8, staged_path(spark, name))
    joined = layout.joined_buckets(spark, names[1], names[0], "id")
    return daily.daily_counts(joined)


@query(
    "orders_by_month_folder",
    f"""SELECT CAST(o_orderdate AS DATE) AS created, count(*) AS n, count(DISTINCT o_custkey) AS customers
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' GROUP BY 1""",
)
def orders_by_month_folder(spark, folder):
    """Ten weeks of orders read from the folders of their three months alone."""
    path = layout.write_by_day(Retail(spark, folder).orders(), staged_path(spark, "by-day"), unit="month")
    days = layout.read_days(spark, path, SINCE, UNTIL, unit="month")
    return days.groupBy(DAY).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("customerId").alias("customers")
    )


@query(
    "customers_by_month_sketch",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS name, count(DISTINCT o_custkey) AS customers,
  TRUE AS within_bound FROM orders GROUP BY 1""",
)
def customers_by_month_sketch(spark, folder):
    """Exact customers of every month, and whether the union of its days' sketches stays in its bound."""
    orders = Retail(spark, folder).orders()
    month = F.date_format(DAY, "yyyy-MM").alias("name")
    ranges = orders.select(month, F.trunc(DAY, "month").alias("first"), F.last_day(DAY).alias("last")).distinct()
    estimated = sketches.customers_between(sketches.customer_sketches(orders), ranges)
    exact = orders.groupBy(month).agg(F.count_distinct("customerId").alias("customers"))
    error = F.abs(F.col("unique_customers") - F.col("customers"))
    return exact.join(estimated, "name").select(
        "name", "customers", (error <= sketches.error_bound() * F.col("customers")).alias("within_bound")
    )


@query(
    "grid_expand",
    """WITH a AS (SELECT DISTINCT o_orderpriority AS channel FROM orders),
b AS (SELECT DISTINCT l_returnflag AS flag FROM lineitem), c AS (SELECT DISTINCT event_type FROM events)
SELECT CAST(row_number() OVER (ORDER BY channel, flag, event_type) - 1 AS BIGINT) AS run_id, channel, flag, event_type
FROM a, b, c""",
)
def grid_expand(spark, folder):
    """A grid over values found in three tables, numbered in key order."""
    retail = Retail(spark, folder)
    axes = {
        "channel": retail.orders().select("channel"),
        "flag": retail.table("lineitem").select("l_returnflag"),
        "event_type": retail.table("events").select("event_type"),
    }
    return grid_rows(axes)


@query(
    "datasets_round_trip",
    with_(
        o.LINES + ",\n" + o.spends() + ",\n" + o.EVENTS,
        f"""SELECT 'orders' AS name, created AS day, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS amount
FROM lines WHERE created >= DATE '{SINCE}' GROUP BY created
UNION ALL SELECT 'ad_spends', date, 1, totalMerchSold FROM spends WHERE date >= DATE '{SINCE}'
UNION ALL SELECT 'events', startDate, 1, 0 FROM event_days WHERE startDate >= DATE '{SINCE}'""",
    ),
)
def datasets_round_trip(spark, folder):
    """The three source tables built in one go, read back and counted by day."""
    retail = Retail(spark, folder)
    written = flows.build_datasets(
        retail.nested_orders(), retail.ad_spends(), retail.event_days(), staged_path(spark, "datasets"), since=SINCE
    )
    read = {name: spark.read.parquet(paths["parquet"]) for name, paths in written.items()}
    lines = items.item_numbers(read["orders"])
    parts = [
        lines.groupBy(F.lit("orders").alias("name"), F.col(DAY).alias("day")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("bigint").alias("amount")
        ),
        read["ad_spends"].select(F.lit("ad_spends"), "date", F.lit(1), F.col("totalMerchSold").cast("bigint")),
        read["events"].select(F.lit("events"), "startDate", F.lit(1), F.lit(0)),
    ]
    return parts[0].union(parts[1]).union(parts[2])

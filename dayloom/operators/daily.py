"""Aggregation of order lines to one row per day (and per series key)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions import as_column, clean_number, weekday_of
from dayloom.schemas import COUNT_COLUMNS, MONEY_COLUMNS, PANEL_COLUMNS

DAY = "created"


def daily_counts(
    lines: DataFrame, keys: Sequence[str] = (), *, weight: Column | str | None = None
) -> DataFrame:
    """Daily ``orders``. A unit is one **line-item row**, so an order of three lines counts 3.

    ``weight`` lets already grouped input (say one row per order with its line count) stand
    for the lines behind it; ``weight=lit(1)`` over order rows counts orders instead.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(as_column(weight))
    dated = lines.filter(F.col(DAY).isNotNull())
    return dated.groupBy(*keys, DAY).agg(size.cast("bigint").alias("orders"))


def daily_order_stats(
    lines: DataFrame,
    keys: Sequence[str] = (),
    *,
    customer: str = "customerId",
    order_number: str | None = "order_number_for_customer",
    first_order: Column | None = None,
    weight: Column | str | None = None,
) -> DataFrame:
    """Orders, distinct customers, new customers and mean order number per day, in one pass.

    Grouping by (day, customer) first makes the distinct counts plain counts of the second
    grouping. Both steps combine map-side, and a day or customer owning a large share of the
    rows has shrunk to one row per pair before the second shuffle.
    """
    size = F.lit(1) if weight is None else as_column(weight)
    number = clean_number(order_number) if order_number else F.lit(None).cast("double")
    if first_order is None:
        first_order = number == 1
    per_customer = (
        lines.filter(F.col(DAY).isNotNull())
        .groupBy(*keys, DAY, customer)
        .agg(
            F.sum(size).cast("bigint").alias("_lines"),
            F.max(F.coalesce(first_order, F.lit(False))).alias("_new"),
            F.sum(number * size).alias("_number"),
            F.sum(F.when(number.isNotNull(), size)).alias("_numbered"),
        )
    )
    known = F.col(customer).isNotNull()
    return per_customer.groupBy(*keys, DAY).agg(
        F.sum("_lines").alias("orders"),
        F.count(customer).alias("unique_customers"),
        F.count_if(known & F.col("_new")).alias("new_customers"),
        F.try_divide(F.sum("_number"), F.sum("_numbered").cast("double")).alias(
            "avg_order_number_for_customer"
        ),
    )


def daily_unique_customers(
    lines: DataFrame,
    keys: Sequence[str] = (),
    *,
    customer: str = "customerId",
    approximate: bool = False,
) -> DataFrame:
    """Distinct customers per day; ``approximate`` trades exactness for a sketch per day."""
    known = lines.dropna(subset=[DAY, customer])
    if approximate:
        count = F.approx_count_distinct(customer)
        return known.groupBy(*keys, DAY).agg(count.alias("unique_customers"))
    pairs = known.select(*keys, DAY, customer).distinct()
    return pairs.groupBy(*keys, DAY).agg(F.count(F.lit(1)).alias("unique_customers"))


def daily_new_customers(
    lines: DataFrame,
    keys: Sequence[str] = (),
    *,
    customer: str = "customerId",
    first_order: Column | None = None,
) -> DataFrame:
    """Distinct customers whose first order falls on the day."""
    if first_order is None:
        first_order = clean_number("order_number_for_customer") == 1
    return daily_unique_customers(lines.filter(first_order), keys, customer=customer).select(
        *keys, DAY, F.col("unique_customers").alias("new_customers")
    )


def calendar_buckets(
    lines: DataFrame, bucket: Column, buckets: range, name: str, weight: Column | str | None = None
) -> DataFrame:
    """Line counts of every bucket in ``buckets`` (7 weekdays, 12 months), 0 where none fell."""
    size = F.count(F.lit(1)) if weight is None else F.sum(as_column(weight))
    counts = lines.groupBy(bucket.alias(name)).agg(size.cast("bigint").alias("orders"))
    spark = lines.sparkSession
    frame = spark.range(buckets.start, buckets.stop).select(F.col("id").cast("int").alias(name))
    return frame.join(counts, name, "left").select(
        name, F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders")
    )


def orders_by_weekday(lines: DataFrame, weight: Column | str | None = None) -> DataFrame:
    return calendar_buckets(lines, weekday_of(DAY), range(0, 7), "created_weekday", weight)


def orders_by_month(lines: DataFrame, weight: Column | str | None = None) -> DataFrame:
    return calendar_buckets(lines, F.month(DAY), range(1, 13), "created_month", weight)


def product_daily_units(lines: DataFrame, label: str = "product_label") -> DataFrame:
    """Units sold per day and product."""
    return lines.groupBy(DAY, label).agg(F.sum("quantity").alias("quantity"))


def product_matrix(units: DataFrame, label: str = "product_label") -> DataFrame:
    """Every product on every observed day, 0 where nothing was sold (long form).

    The list of observed days is bounded by the calendar, so it travels as one array value;
    each product unfolds it on its own. The output is inherently products x days: use it for
    product sets of report size and :func:`product_daily_units` otherwise.
    """
    days = units.select(DAY).distinct().agg(F.collect_list(DAY)).scalar()
    grid = units.select(label).distinct().select(label, F.explode(days).alias(DAY))
    return grid.join(units, [label, DAY], "left").select(
        DAY, label, F.coalesce("quantity", F.lit(0.0)).alias("quantity")
    )


def product_pivot(
    units: DataFrame, labels: Sequence[str], label: str = "product_label"
) -> DataFrame:
    """One column per listed product, one row per day, 0 where nothing was sold."""
    wide = units.groupBy(DAY).pivot(label, list(labels)).agg(F.sum("quantity"))
    return wide.fillna(0.0, subset=list(labels))


def product_launches(units: DataFrame, label: str = "product_label") -> DataFrame:
    """First day on which a product sold more than one unit; products without one are left out."""
    launch = F.min(F.when(F.col("quantity") > 1, F.col(DAY)))
    return units.groupBy(label).agg(launch.alias("launch_day")).dropna(subset=["launch_day"])


def since_launch(
    units: DataFrame,
    launches: DataFrame | None = None,
    label: str = "product_label",
    *,
    zeros: bool = False,
) -> DataFrame:
    """Rows of each launched product from its launch day on; with ``zeros`` also the observed days
    without a sale (see :func:`product_matrix`)."""
    launches = product_launches(units, label) if launches is None else launches
    if zeros:
        units = product_matrix(units, label)
    return units.join(launches, label).filter(F.col(DAY) >= F.col("launch_day"))


def combined_daily(
    stats: DataFrame,
    spends: DataFrame,
    events: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Daily panel: order statistics, ad spend and event flag of every day known to either side.

    Both inputs hold one row per (keys, day), so the full outer join runs on their existing
    hash partitioning. Days with spend only have 0 orders; spend of order-only days stays NULL.
    Distinct event days number at most one per calendar day, which bounds the broadcast side.
    """
    sides = spends.select(
        *keys, F.col("date").alias(DAY), *[c for c in (*MONEY_COLUMNS, *COUNT_COLUMNS)]
    )
    panel = stats.join(sides, [*keys, DAY], "full")
    if events is None:
        flagged = panel.withColumn("event_start", F.lit(0))
    else:
        days = events.select(F.col("startDate").alias(DAY)).dropna().distinct()
        marks = days.withColumn("event_start", F.lit(1))
        flagged = panel.join(F.broadcast(marks), DAY, "left")
    zero_filled = {
        c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
        for c in ("orders", "unique_customers", "new_customers")
    }
    return flagged.withColumns(
        {
            **zero_filled,
            "event_start": F.coalesce("event_start", F.lit(0)),
            "created_weekday": weekday_of(DAY),
            "created_month": F.month(DAY),
        }
    ).select(*keys, DAY, *PANEL_COLUMNS)

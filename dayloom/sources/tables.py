"""Table scans: order lines, ad spend, events and bounded revenue history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions import as_column, clean_number, day_of, weekday_of, whole_number
from dayloom.operators.items import explode_items
from dayloom.schemas import COUNT_COLUMNS, MONEY_COLUMNS

# Fixed value: default start of the history that the scans read.
HISTORY_START = "2023-01-01"

ORDER_COLUMNS = (
    "id",
    "created",
    "customerId",
    "channel",
    "sourceName",
    "tags",
    "order_number_for_customer",
)


def read_table(
    spark: SparkSession,
    name: str,
    *,
    format: str = "parquet",
    options: Mapping[str, str] | None = None,
    schema=None,
) -> DataFrame:
    """Open a table: a path for file formats, a table name for ``jdbc`` or the catalog.

    A JDBC read should carry ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` in ``options`` so that executors pull ranges in parallel; the date
    filter of the scans below is pushed into the remote query.
    """
    if format == "catalog":
        return spark.read.table(name)
    reader = spark.read.format(format).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    if format == "jdbc":
        return reader.option("dbtable", name).load()
    return reader.load(name)


def scan_order_lines(
    orders: DataFrame,
    *,
    items: str = "line_items",
    since: str = HISTORY_START,
    columns: Sequence[str] = ORDER_COLUMNS,
) -> DataFrame:
    """One row per line item, with weekday and month of the order day.

    Orders whose item list is empty or unreadable give no row. The date filter and the
    column list reach the scan.
    """
    kept = [c for c in columns if c in orders.columns and c != "created"]
    lines = explode_items(
        orders.filter(F.col("created") >= F.lit(since).cast(orders.schema["created"].dataType)),
        items,
        [day_of("created").alias("created"), *kept],
    )
    return lines.select(
        "created",
        weekday_of("created").alias("created_weekday"),
        F.month("created").alias("created_month"),
        *kept,
        "productId",
        "title",
        "quantity",
    )


def scan_ad_spends(spends: DataFrame, *, since: str = HISTORY_START) -> DataFrame:
    """Daily spend rows with declared types: money as DOUBLE, counts as BIGINT, NULL as 0."""
    kept = spends.filter(F.col("date") >= F.lit(since).cast(spends.schema["date"].dataType))
    return kept.select(
        day_of("date").alias("date"),
        *[F.coalesce(clean_number(c), F.lit(0.0)).alias(c) for c in MONEY_COLUMNS],
        *[whole_number(c).alias(c) for c in COUNT_COLUMNS],
    )


def profile_ad_spends(spends: DataFrame) -> DataFrame:
    """Spend rows for reporting: numbers coerced (NULL stays NULL), undated rows dropped."""
    metrics = [c for c in (*MONEY_COLUMNS, *COUNT_COLUMNS) if c in spends.columns]
    return spends.select(
        day_of("date").alias("date"), *[clean_number(c).alias(c) for c in metrics]
    ).dropna(subset=["date"])


def scan_event_days(
    events: DataFrame, *, column: str = "startDate", since: str | None = HISTORY_START
) -> DataFrame:
    """Distinct event days. At most one row per calendar day, whatever the input size."""
    days = events.select(day_of(column).alias("startDate")).dropna()
    if since is not None:
        days = days.filter(F.col("startDate") >= F.lit(since).cast("date"))
    return days.distinct()


def events_between(days: DataFrame, series: DataFrame, *, day: str = "created") -> DataFrame:
    """Event days inside the covered range of ``series`` (both ends included)."""
    span = series.agg(F.struct(F.min(day).alias("first"), F.max(day).alias("last"))).scalar()
    return days.filter(
        (F.col("startDate") >= span["first"]) & (F.col("startDate") <= span["last"])
    )


def history_before(
    table: DataFrame,
    before: str,
    *,
    day: str = "date",
    value: str = "totalRevenue",
    limit: int = 500,
) -> DataFrame:
    """The newest ``limit`` non-null values strictly before a day (a top-N, never a full sort of
    the table), oldest first."""
    newest = (
        table.select(day_of(day).alias(day), as_column(value).cast("double").alias(value))
        .filter((F.col(day) < F.lit(before).cast("date")) & F.col(value).isNotNull())
        .orderBy(F.col(day).desc())
        .limit(limit)
    )
    return newest.orderBy(day)


def daily_value(table: DataFrame, value: str, *, day: str = "created") -> DataFrame:
    """One numeric column of a panel with its day; rows lacking either are dropped."""
    return table.select(day_of(day).alias(day), clean_number(value).alias(value)).dropna()

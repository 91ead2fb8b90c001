"""Declared schemas of the tables that enter and leave the library."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM = T.StructType(
    [
        T.StructField("productId", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("quantity", T.StringType()),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created", T.TimestampType()),
        T.StructField("customerId", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("sourceName", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("order_number_for_customer", T.IntegerType()),
        T.StructField("line_items", T.ArrayType(ITEM)),
    ]
)

MONEY_COLUMNS = ("adSpend", "rcRevenue", "totalRevenue")
COUNT_COLUMNS = (
    "totalMerchSold",
    "totalNewCustomerBarsSold",
    "totalRecurringCustomerBarsSold",
)

AD_SPENDS = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in MONEY_COLUMNS]
    + [T.StructField(c, T.LongType()) for c in COUNT_COLUMNS]
)

EVENTS = T.StructType([T.StructField("startDate", T.DateType())])

PREDICTION_ERRORS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("sample_idx", T.LongType()),
        T.StructField("y_true", T.DoubleType()),
        T.StructField("y_pred", T.DoubleType()),
        T.StructField("mape", T.DoubleType()),
        T.StructField("created", T.DateType()),
    ]
)

METRICS = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("mae", T.DoubleType()),
            T.StructField("rmse", T.DoubleType()),
            T.StructField("mape", T.DoubleType()),
            T.StructField("error", T.StringType()),
        ]
    ),
)

# Column order of the daily panel before features are added.
PANEL_COLUMNS = (
    "orders",
    *MONEY_COLUMNS,
    *COUNT_COLUMNS,
    "created_weekday",
    "created_month",
    "unique_customers",
    "new_customers",
    "event_start",
)

"""Order, spend and event tables derived from a star schema of orders, line items and parts."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayloom.operators.calendar import trim_last_day
from dayloom.operators.daily import combined_daily, daily_counts, daily_order_stats
from dayloom.operators.features import feature_panel

DAY = "created"
# A long id as a decimal that is not negative, and the number of such ids.
ID_LEAST, ID_SPAN = Decimal(1 << 63), Decimal(1 << 64)
ITEMS = 8  # line numbers of an order that share a fragment
ID_RANGE = 1 << 16  # order ids ranked together within a customer's day


class Retail:
    """The library's input tables over one folder of Parquet tables.

    Line items are grouped by order before they meet the orders where only their number counts;
    the grouping leaves them partitioned for that join. Joins with parts are plain equi-joins:
    Spark broadcasts a part table below its size limit and otherwise splits skewed partitions
    of a hot part at run time.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.to_date("o_orderdate").alias(DAY),
            F.col("o_custkey").alias("customerId"),
            F.col("o_orderpriority").alias("channel"),
            F.col("o_orderstatus").alias("sourceName"),
        )

    def parts(self, *columns: str) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("productId"), *columns)

    def numbered_orders(self) -> DataFrame:
        """Orders with the running number of each customer's orders; NULL without a customer.

        A customer's days are counted first and only those totals are accumulated per customer
        (one row per calendar day at most), then the ranges of ID_RANGE ids within a day; single
        orders are ranked within their range. So no task ever holds all orders of a customer or
        of a customer's day, and a later join by order id is free to split a hot order.
        """
        orders = self.orders().withColumn("_range", F.floor(F.col("id") / ID_RANGE))
        known = orders.filter(F.col("customerId").isNotNull() & F.col(DAY).isNotNull())
        per_range = known.groupBy("customerId", DAY, "_range").agg(F.count(F.lit(1)).alias("_n"))
        per_day = per_range.groupBy("customerId", DAY).agg(F.sum("_n").alias("_n"))

        def before(*within: str, by: str):
            rows = W.partitionBy(*within).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
            return F.coalesce(F.sum("_n").over(rows), F.lit(0))

        days = per_day.select("customerId", DAY, before("customerId", by=DAY).alias("_days"))
        ranges = per_range.select(
            "customerId", DAY, "_range", before("customerId", DAY, by="_range").alias("_ranges")
        )
        offsets = ranges.join(days, ["customerId", DAY])
        rank = F.row_number().over(W.partitionBy("customerId", DAY, "_range").orderBy("id"))
        number = F.col("_days") + F.col("_ranges") + rank
        numbered = known.join(offsets, ["customerId", DAY, "_range"]).withColumn(
            "order_number_for_customer", number.cast("bigint")
        )
        rest = orders.filter(F.col("customerId").isNull() | F.col(DAY).isNull()).withColumn(
            "order_number_for_customer", F.lit(None).cast("bigint")
        )
        columns = [*self.orders().columns, "order_number_for_customer"]
        return numbered.select(columns).unionByName(rest.select(columns))

    def first_orders(self) -> DataFrame:
        """``id`` of every customer's first order, by day and id.

        Day and id are one decimal, whose minimum is a hash aggregate combined before the shuffle (that
        of a struct would sort all orders), so neither a customer nor its day is ever gathered.
        """
        place = F.unix_date(DAY).cast("decimal(38,0)") * ID_SPAN + F.col("id").cast("decimal(20,0)") + ID_LEAST
        first = (
            self.orders()
            .filter(F.col("customerId").isNotNull() & F.col(DAY).isNotNull() & F.col("id").isNotNull())
            .groupBy("customerId")
            .agg(F.min(place.cast("decimal(38,0)")).alias("_first"))
        )
        return first.select((F.pmod("_first", ID_SPAN) - ID_LEAST).cast("bigint").alias("id"))

    def flagged_orders(self) -> DataFrame:
        """Orders with ``first_order``: whether it is its customer's first, by day and id."""
        first = self.first_orders().withColumn("first_order", F.lit(True))
        flag = F.coalesce("first_order", F.lit(False))
        return self.orders().join(first, "id", "left").withColumn("first_order", flag)

    def _orders(self, numbered: bool, flagged: bool) -> DataFrame:
        if numbered:
            return self.numbered_orders()
        return self.flagged_orders() if flagged else self.orders()

    def line_counts(self) -> DataFrame:
        """Line items per order id."""
        return (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("id"))
            .agg(F.count(F.lit(1)).alias("lines"))
        )

    def order_facts(self, *, numbered: bool = False, flagged: bool = False) -> DataFrame:
        """One row per order that has line items, with their number as ``lines``."""
        return self.line_counts().join(self._orders(numbered, flagged), "id")

    def order_lines(self, *, numbered: bool = False, flagged: bool = False) -> DataFrame:
        """Line items with the day and customer of their order."""
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("id"),
            F.col("l_partkey").alias("productId"),
            F.col("l_quantity").alias("quantity"),
        )
        return lines.join(self._orders(numbered, flagged), "id")

    def lines_by(
        self, *part_columns: str, numbered: bool = False, flagged: bool = False
    ) -> DataFrame:
        """Line items with day and customer of their order and attributes of their part."""
        lines = self.order_lines(numbered=numbered, flagged=flagged)
        return lines.join(self.parts(*part_columns), "productId")

    def product_days(self, label: str | None = None) -> DataFrame:
        """Units per (day, product_label): the part key as text, or a part attribute."""
        if label is None:
            lines = self.order_lines()
            name = F.col("productId")
        else:
            lines, name = self.lines_by(label), F.col(label)
        units = lines.groupBy(DAY, name.alias("product_label")).agg(
            F.sum("quantity").alias("quantity")
        )
        return units.withColumn("product_label", F.col("product_label").cast("string"))

    def nested_orders(self) -> DataFrame:
        """Orders carrying an array of items; orders without items carry an empty one.

        An order arrives in fragments of one flag and up to ITEMS consecutive line numbers, so no
        order, however large, is gathered into a single array.
        """
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("id"),
            F.col("l_partkey").alias("productId"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_returnflag").alias("flag"),
            F.floor(F.col("l_linenumber") / ITEMS).alias("_part"),
        )
        item = F.struct(
            F.col("productId").cast("string").alias("productId"),
            F.col("p_type").alias("title"),
            F.col("quantity").cast("string").alias("quantity"),
        )
        orders = self.numbered_orders()
        parted = lines.join(self.parts("p_type"), "productId").groupBy("id", "flag", "_part")
        filled = parted.agg(F.sort_array(F.collect_list(item)).alias("line_items")).drop("_part")
        empty = orders.join(self.line_counts(), "id", "left_anti").withColumns(
            {"flag": F.lit(None).cast("string"), "line_items": F.array().cast(filled.schema["line_items"].dataType)}
        )
        return filled.join(orders, "id").unionByName(empty)

    def item_documents(self) -> DataFrame:
        """The nested orders with items as JSON text: a lone item of flag A as an object, else an array.

        Lines flagged N have no title.
        """
        nested = self.nested_orders()
        untitled = F.transform("line_items", lambda e: e.dropFields("title"))
        text = (
            F.when(
                (F.col("flag") == "A") & (F.size("line_items") == 1),
                F.to_json(F.get("line_items", F.lit(0))),
            )
            .when(F.col("flag") == "N", F.to_json(untitled))
            .otherwise(F.to_json("line_items"))
        )
        return nested.withColumn("line_items", text)

    def ad_spends(self, part_column: str | None = None) -> DataFrame:
        """Daily spend and revenue by ship day (and part attribute)."""
        revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        flag, quantity = F.col("l_returnflag"), F.col("l_quantity")
        sums = {
            "adSpend": F.col("l_extendedprice") * F.col("l_discount"),
            "rcRevenue": F.when(flag == "R", revenue).otherwise(0.0),
            "totalRevenue": revenue,
            "totalMerchSold": quantity,
            "totalNewCustomerBarsSold": F.when(flag == "N", quantity).otherwise(0.0),
            "totalRecurringCustomerBarsSold": F.when(flag == "A", quantity).otherwise(0.0),
        }
        lines = self.table("lineitem").select(
            F.col("l_partkey").alias("productId"),
            F.to_date("l_shipdate").alias("date"),
            *[v.alias(c) for c, v in sums.items()],
        )
        totals = [F.sum(c).alias(c) for c in sums]
        keys = [part_column] if part_column else []
        if part_column:
            lines = lines.join(self.parts(part_column), "productId")
        daily = lines.groupBy(*keys, "date").agg(*totals)
        money = ("adSpend", "rcRevenue", "totalRevenue")
        return daily.select(
            *keys,
            "date",
            *[
                F.round(c, 4).alias(c) if c in money else F.col(c).cast("bigint").alias(c)
                for c in sums
            ],
        )

    def event_days(self) -> DataFrame:
        """Quarter-end mid-month order days: 15 March, June, September, December."""
        day = F.col(DAY)
        return (
            self.orders()
            .filter((F.dayofmonth(day) == 15) & F.month(day).isin(3, 6, 9, 12))
            .select(day.alias("startDate"))
            .distinct()
        )

    def combined(self, part_column: str | None = None) -> DataFrame:
        """The daily panel of all tables."""
        keys = [part_column] if part_column else []
        if part_column:
            lines, weight = self.lines_by(part_column, flagged=True), None
        else:
            lines, weight = self.order_facts(flagged=True), "lines"
        stats = daily_order_stats(
            lines, keys, order_number=None, first_order=F.col("first_order"), weight=weight
        )
        return combined_daily(stats, self.ad_spends(part_column), self.event_days(), keys)

    def panel(self, part_column: str | None = None, lags: Sequence[int] = (1, 7, 30)) -> DataFrame:
        """The feature panel of all tables, without the open last day."""
        keys = [part_column] if part_column else []
        return feature_panel(trim_last_day(self.combined(part_column), keys), keys, lags=lags)

    def series(self, part_column: str | None = None) -> DataFrame:
        """(keys, created, y): daily line counts, observed days only."""
        if part_column:
            daily, keys = daily_counts(self.lines_by(part_column), [part_column]), [part_column]
        else:
            daily, keys = daily_counts(self.order_facts(), weight="lines"), []
        return daily.select(*keys, DAY, F.col("orders").cast("double").alias("y"))

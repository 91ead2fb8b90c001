"""Queries: scans, daily aggregation, joins, products, profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.functions import weekday_of
from dayloom.operators import calendar, daily, evaluate, features, items, profile
from dayloom.operators.daily import DAY
from dayloom.plans import oracle as o
from dayloom.plans.catalog import query, tidy
from dayloom.plans.oracle import BRAND, with_
from dayloom.session import staged_path
from dayloom.sources import files, overrides, tables
from dayloom.sources.retail import Retail

START = "1996-03-10"  # inside the range of all three tables


@query(
    "order_lines_scan",
    with_(
        o.LINES,
        """SELECT id, created, CAST(isodow(created) - 1 AS INT) AS created_weekday,
  CAST(month(created) AS INT) AS created_month, customerId, channel, sourceName,
  order_number_for_customer, productId, p_type AS title, CAST(quantity AS BIGINT) AS quantity
FROM lines WHERE created >= DATE '1996-03-10'""",
    ),
)
def order_lines_scan(spark, folder):
    orders = Retail(spark, folder).nested_orders()
    return items.item_numbers(tables.scan_order_lines(orders, since=START))


@query(
    "line_items_flat",
    with_(
        o.LINES,
        """SELECT id, created, quantity,
  CASE WHEN flag = 'N' THEN CAST(productId AS VARCHAR) ELSE p_type END AS product_label
FROM lines WHERE created >= DATE '1996-03-10'""",
    ),
)
def line_items_flat(spark, folder):
    documents = Retail(spark, folder).item_documents()
    lines = tables.scan_order_lines(documents, since=START)
    return items.item_labels(lines).select("id", DAY, "quantity", "product_label")


_SPEND_COLUMNS = ("date", *o.MONEY, *o.UNITS)


@query(
    "ad_spends_daily",
    with_(o.spends(), f"SELECT {', '.join(_SPEND_COLUMNS)} FROM spends WHERE date >= DATE '{START}'"),
)
def ad_spends_daily(spark, folder):
    return tables.scan_ad_spends(Retail(spark, folder).ad_spends(), since=START)


@query(
    "ad_spends_reported",
    with_(
        o.spends(),
        f"""SELECT date, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SPEND_COLUMNS[1:])}
FROM spends WHERE date IS NOT NULL""",
    ),
)
def ad_spends_reported(spark, folder):
    return tables.profile_ad_spends(Retail(spark, folder).ad_spends())


@query(
    "ad_spends_round_trip",
    with_(
        o.spends(),
        f"""SELECT f AS format, {", ".join(_SPEND_COLUMNS)} FROM spends, (VALUES ('parquet'), ('jsonl'), ('csv')) v(f)""",
    ),
)
def ad_spends_round_trip(spark, folder):
    """Spend written in every format and read back with its declared types."""
    spends = Retail(spark, folder).ad_spends().select(*_SPEND_COLUMNS)
    base = staged_path(spark, "spends")
    paths = files.write_dataset(spends, base, "spends") | files.write_dataset(spends, base, "spends", "both")
    read = {
        "parquet": spark.read.parquet(paths["parquet"]),
        "jsonl": files.read_json_lines(spark, paths["jsonl"], spends.schema),
        "csv": spark.read.schema(spends.schema).csv(paths["csv"], header=True),
    }
    whole = None
    for name, frame in read.items():
        part = frame.select(F.lit(name).alias("format"), *_SPEND_COLUMNS)
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query("event_starts", with_(o.EVENTS, f"SELECT startDate FROM event_days WHERE startDate >= DATE '{START}'"))
def event_starts(spark, folder):
    return tables.scan_event_days(Retail(spark, folder).event_days(), since=START)


@query(
    "events_in_range",
    with_(
        o.EVENTS + ",\n" + o.spends(),
        """SELECT startDate FROM event_days
WHERE startDate BETWEEN (SELECT min(date) FROM spends) AND (SELECT max(date) FROM spends)""",
    ),
)
def events_in_range(spark, folder):
    retail = Retail(spark, folder)
    return tables.events_between(retail.event_days(), retail.ad_spends(), day="date")


@query(
    "revenue_history_before",
    with_(
        o.spends(),
        """SELECT date, totalRevenue FROM spends WHERE date < DATE '2001-10-01'
ORDER BY date DESC LIMIT 500""",
    ),
)
def revenue_history_before(spark, folder):
    return tables.history_before(Retail(spark, folder).ad_spends(), "2001-10-01")


@query(
    "normalize_epoch",
    """SELECT id, created, CAST(isodow(created) - 1 AS INT) AS created_weekday,
  CAST(month(created) AS INT) AS created_month
FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + 10000 AS created FROM orders)""",
)
def normalize_epoch(spark, folder):
    orders = Retail(spark, folder).table("orders")
    # The unit rule reads numbers below 1e12 as seconds, so the days move past 2001.
    moved = F.date_add(F.to_date("o_orderdate"), 10000).cast("timestamp")
    stamps = orders.select(F.col("o_orderkey").alias("id"), F.unix_millis(moved).alias(DAY))
    return items.normalize_created(stamps).drop("created_dt")


@query(
    "normalize_epoch_seconds",
    """SELECT id, created, CAST(isodow(created) - 1 AS INT) AS created_weekday,
  CAST(month(created) AS INT) AS created_month
FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + 10000 AS created FROM orders)""",
)
def normalize_epoch_seconds(spark, folder):
    orders = Retail(spark, folder).table("orders")
    moved = F.date_add(F.to_date("o_orderdate"), 10000).cast("timestamp")
    stamps = orders.select(F.col("o_orderkey").alias("id"), F.unix_seconds(moved).alias(DAY))
    return items.normalize_created(stamps).drop("created_dt")


@query(
    "normalize_epoch_small",
    """SELECT o_orderkey AS id, DATE '1970-01-01' AS created, CAST(3 AS INT) AS created_weekday,
  CAST(1 AS INT) AS created_month FROM orders""",
)
def normalize_epoch_small(spark, folder):
    """Numbers below 1e9 are nanoseconds: all within the first second."""
    orders = Retail(spark, folder).table("orders")
    number = F.pmod(F.col("o_orderkey"), F.lit(999_999_999))
    return items.normalize_created(
        orders.select(F.col("o_orderkey").alias("id"), number.alias(DAY))
    ).drop("created_dt")


@query(
    "future_overrides",
    with_(o.spends(BRAND), "SELECT p_brand, date AS created, adSpend AS value FROM spends"),
)
def future_overrides(spark, folder):
    spends = Retail(spark, folder).ad_spends(BRAND)

    def entry(text, value):
        return F.struct(text.alias("date"), value.alias("value"))

    day = F.col("date").cast("string")
    # Every day appears twice; the later entry has to win.
    stale = entry(day, F.lit(-1.0))
    fresh = entry(F.concat(day, F.lit("T10:00:00Z")), F.col("adSpend"))
    documents = spends.groupBy(BRAND).agg(
        F.to_json(F.flatten(F.collect_list(F.array(stale, fresh)))).alias("future_ad_spend")
    )
    return overrides.parse_overrides(documents, "future_ad_spend", [BRAND])


@query(
    "daily_orders",
    """SELECT CAST(o_orderdate AS DATE) AS created, count(*) AS orders
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def daily_orders(spark, folder):
    return daily.daily_counts(Retail(spark, folder).order_facts(), weight="lines")


@query(
    "daily_unique_customers",
    """SELECT CAST(o_orderdate AS DATE) AS created, count(DISTINCT o_custkey) AS unique_customers
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL""",
)
def daily_unique_customers(spark, folder):
    return daily.daily_unique_customers(Retail(spark, folder).order_facts())


@query(
    "daily_new_customers",
    with_(
        o.LINES,
        """SELECT created, count(DISTINCT customerId) AS new_customers FROM lines
WHERE order_number_for_customer = 1 GROUP BY ALL""",
    ),
)
def daily_new_customers(spark, folder):
    facts = Retail(spark, folder).order_facts(flagged=True)
    return daily.daily_new_customers(facts, first_order=F.col("first_order"))


@query(
    "daily_avg_order_number",
    with_(
        o.LINES,
        f"""SELECT created, {o.r6("avg(order_number_for_customer)", "avg_order_number_for_customer")}
FROM lines GROUP BY ALL""",
    ),
)
def daily_avg_order_number(spark, folder):
    facts = Retail(spark, folder).order_facts(numbered=True)
    stats = daily.daily_order_stats(facts, weight="lines")
    return tidy(stats.select(DAY, "avg_order_number_for_customer"))


@query(
    "orders_by_weekday",
    with_(
        o.LINES,
        """SELECT CAST(b AS INT) AS created_weekday, count(created) AS orders
FROM generate_series(0, 6) g(b) LEFT JOIN lines ON isodow(created) - 1 = b GROUP BY ALL""",
    ),
)
def orders_by_weekday(spark, folder):
    return daily.orders_by_weekday(Retail(spark, folder).order_facts(), "lines")


@query(
    "orders_by_month",
    with_(
        o.LINES,
        """SELECT CAST(b AS INT) AS created_month, count(created) AS orders
FROM generate_series(1, 12) g(b) LEFT JOIN lines ON month(created) = b GROUP BY ALL""",
    ),
)
def orders_by_month(spark, folder):
    return daily.orders_by_month(Retail(spark, folder).order_facts(), "lines")


_UNITS_BY_PART = """SELECT created, CAST(productId AS VARCHAR) AS product_label,
  sum(quantity) AS quantity FROM lines GROUP BY ALL"""


@query("product_daily_units", with_(o.LINES, _UNITS_BY_PART))
def product_daily_units(spark, folder):
    return Retail(spark, folder).product_days()


@query(
    "product_pivot",
    with_(
        o.LINES
        + """, units AS (
  SELECT created, p_type AS product_label, sum(quantity) AS quantity FROM lines GROUP BY ALL)""",
        """SELECT d.created, p.product_label, coalesce(quantity, 0.0) AS quantity
FROM (SELECT DISTINCT created FROM units) d CROSS JOIN (SELECT DISTINCT product_label FROM units) p
LEFT JOIN units u ON u.created = d.created AND u.product_label = p.product_label""",
    ),
)
def product_pivot(spark, folder):
    return daily.product_matrix(Retail(spark, folder).product_days("p_type"))


_TYPES = ("ECONOMY", "STANDARD", "PROMO", "LARGE", "SMALL", "MEDIUM")


@query(
    "product_pivot_wide",
    with_(
        o.LINES,
        "SELECT created, "
        + ", ".join(
            f"coalesce(sum(quantity) FILTER (p_type = '{t}'), 0.0) AS {t}" for t in _TYPES
        )
        + " FROM lines GROUP BY ALL",
    ),
)
def product_pivot_wide(spark, folder):
    units = Retail(spark, folder).product_days("p_type").filter("product_label IS NOT NULL")
    labels = [r[0] for r in units.select("product_label").distinct().orderBy("product_label").collect()]
    return daily.product_pivot(units, labels)


@query(
    "product_since_launch",
    with_(
        o.LINES
        + """, units AS (
  SELECT created, p_type AS product_label, sum(quantity) AS quantity FROM lines GROUP BY ALL),
launches AS (
  SELECT product_label, min(created) AS launch_day FROM units WHERE quantity > 1 GROUP BY ALL)""",
        """SELECT d.created, l.product_label, launch_day, coalesce(quantity, 0.0) AS quantity
FROM (SELECT DISTINCT created FROM units) d JOIN launches l ON d.created >= launch_day
LEFT JOIN units u ON u.created = d.created AND u.product_label = l.product_label""",
    ),
)
def product_since_launch(spark, folder):
    return daily.since_launch(Retail(spark, folder).product_days("p_type"), zeros=True)


@query(
    "product_launch",
    with_(
        o.LINES
        + f""", units AS ({_UNITS_BY_PART}),
launches AS (
  SELECT product_label, min(created) AS launch_day FROM units WHERE quantity > 1 GROUP BY ALL)""",
        """SELECT product_label, launch_day, count(*) AS sale_days, sum(quantity) AS units
FROM units JOIN launches USING (product_label) WHERE created >= launch_day GROUP BY ALL""",
    ),
)
def product_launch(spark, folder):
    rows = daily.since_launch(Retail(spark, folder).product_days())
    return rows.groupBy("product_label", "launch_day").agg(
        F.count(F.lit(1)).alias("sale_days"), F.sum("quantity").alias("units")
    )


_COMBINED = ("created", *o.PANEL)


@query("combined_daily", with_(o.combined(), f"SELECT {', '.join(_COMBINED)} FROM combined"))
def combined_daily(spark, folder):
    return Retail(spark, folder).combined()


@query(
    "combined_daily_by_brand",
    with_(o.combined(BRAND), f"SELECT p_brand, {', '.join(_COMBINED)} FROM combined"),
)
def combined_daily_by_brand(spark, folder):
    return Retail(spark, folder).combined(BRAND)


@query(
    "trim_last_day",
    with_(o.trimmed(BRAND), f"SELECT p_brand, {', '.join(_COMBINED)} FROM trimmed"),
)
def trim_last_day(spark, folder):
    return calendar.trim_last_day(Retail(spark, folder).combined(BRAND), [BRAND])


@query(
    "drop_open_day",
    with_(
        o.series(),
        "SELECT created, y FROM series WHERE created < (SELECT max(created) FROM series)",
    ),
)
def drop_open_day(spark, folder):
    return calendar.drop_open_day(Retail(spark, folder).series())


@query(
    "dedup_keep_last",
    """SELECT CAST(o_orderdate AS DATE) AS created, o_custkey AS customerId,
  max(o_orderkey) AS id, arg_max(o_orderpriority, o_orderkey) AS channel,
  arg_max(o_orderstatus, o_orderkey) AS sourceName
FROM orders GROUP BY ALL""",
)
def dedup_keep_last(spark, folder):
    return calendar.dedup_keep_last(Retail(spark, folder).orders(), ["customerId"], ["id"])


_PROFILED = {
    "order_number_for_customer": "order_number_for_customer",
    "created_weekday": "isodow(created) - 1",
    "created_month": "month(created)",
    "productId": "productId",
    "quantity": "quantity",
}


@query(
    "profile",
    with_(
        o.LINES,
        "\nUNION ALL ".join(
            f"""SELECT '{name}' AS "column", count(v) AS count, count(*) - count(v) AS nulls,
  {o.r6("avg(v)", "mean")}, {o.r6("stddev_samp(v)", "std")}, {o.r6("min(v)", "min")},
  {o.r6("quantile_cont(v, 0.25)", "p25")}, {o.r6("quantile_cont(v, 0.5)", "p50")},
  {o.r6("quantile_cont(v, 0.75)", "p75")}, {o.r6("max(v)", "max")}
FROM (SELECT ({expression})::DOUBLE AS v FROM lines)"""
            for name, expression in _PROFILED.items()
        ),
    ),
)
def profile_lines(spark, folder):
    retail = Retail(spark, folder)
    orders = retail.numbered_orders().select("id", DAY, "order_number_for_customer")
    lines = retail.table("lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_partkey").alias("productId"),
        F.col("l_quantity").alias("quantity"),
    )
    dated = lines.join(orders, "id").select(
        "order_number_for_customer",
        weekday_of(DAY).alias("created_weekday"),
        F.month(DAY).alias("created_month"),
        "productId",
        "quantity",
    )
    return tidy(profile.profile(dated))


@query(
    "orders_events_report",
    with_(
        o.series()
        + ",\n"
        + o.EVENTS
        + """, shown AS (
  SELECT * FROM series WHERE created < (SELECT max(created) FROM series))""",
        """SELECT (SELECT count(*) FROM shown) AS n_points_plotted,
  (SELECT count(*) FROM shown) AS n_days_raw, (SELECT count(*) FROM series) AS n_days_before_trim,
  (SELECT count(*) FROM event_days WHERE startDate BETWEEN (SELECT min(created) FROM shown)
    AND (SELECT max(created) FROM shown)) AS n_events_in_range,
  (SELECT count(*) FROM event_days) AS n_events_total""",
    ),
)
def orders_events_report(spark, folder):
    retail = Retail(spark, folder)
    return evaluate.series_report(retail.series(), retail.event_days())


def _report_sql(shown: str) -> str:
    return with_(
        o.series()
        + ",\n"
        + o.EVENTS
        + f""", trimmed AS (
  SELECT * FROM series WHERE created < (SELECT max(created) FROM series)),
shown AS (
  SELECT created FROM (SELECT created, {shown} AS v FROM trimmed) WHERE v IS NOT NULL)""",
        """SELECT (SELECT count(*) FROM shown) AS n_points_plotted,
  (SELECT count(*) FROM trimmed) AS n_days_raw, (SELECT count(*) FROM series) AS n_days_before_trim,
  (SELECT count(*) FROM event_days WHERE startDate BETWEEN (SELECT min(created) FROM shown)
    AND (SELECT max(created) FROM shown)) AS n_events_in_range,
  (SELECT count(*) FROM event_days) AS n_events_total""",
    )


_PCT = "100 * (y - lag(y) OVER (ORDER BY created)) / nullif(lag(y) OVER (ORDER BY created), 0)"


@query("pct_events_report", _report_sql(_PCT))
def pct_events_report(spark, folder):
    retail = Retail(spark, folder)
    shown = features.pct_change(calendar.drop_open_day(retail.series()), "y")
    return evaluate.series_report(retail.series(), retail.event_days(), shown)


@query("smoothed_events_report", _report_sql(_PCT))
def smoothed_events_report(spark, folder):
    retail = Retail(spark, folder)
    shown = features.pct_change_smoothed(calendar.drop_open_day(retail.series()), "y")
    return evaluate.series_report(retail.series(), retail.event_days(), shown)


@query(
    "daily_value",
    with_(
        o.combined(BRAND),
        "SELECT created, adSpend FROM combined WHERE adSpend IS NOT NULL",
    ),
)
def daily_value(spark, folder):
    return tables.daily_value(Retail(spark, folder).combined(BRAND), "adSpend")

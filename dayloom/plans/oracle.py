"""SQL building blocks that state the expected results over the raw tables."""

from __future__ import annotations

BRAND = "p_brand"
MONEY = ("adSpend", "rcRevenue", "totalRevenue")
UNITS = ("totalMerchSold", "totalNewCustomerBarsSold", "totalRecurringCustomerBarsSold")
PANEL = (
    "orders",
    *MONEY,
    *UNITS,
    "created_weekday",
    "created_month",
    "unique_customers",
    "new_customers",
    "event_start",
)
CYCLES = (
    "created_weekday_sin",
    "created_weekday_cos",
    "created_month_sin",
    "created_month_cos",
)
LAGS = tuple(f"{c}_lag_{k}" for k in (1, 7, 30) for c in ("adSpend", "orders"))
GROWTH = ("revenue_growth", "investment_growth")
FEATURES = (*PANEL, *CYCLES, *LAGS, *GROWTH, "event_start_next_1")
# Share of the data used for training, in binary double arithmetic.
TRAIN = "(1 - 0.2::DOUBLE)"


def r6(expression: str, name: str | None = None) -> str:
    """Rounded double; adding 0.0 turns a negative zero into zero."""
    return f"round(({expression})::DOUBLE, 6) + 0.0 AS {name or expression}"


def key_list(key: str | None) -> str:
    return f"{key}, " if key else ""


def over(key: str | None, order: str = "", frame: str = "") -> str:
    part = f"PARTITION BY {key} " if key else ""
    return f"OVER ({part}{'ORDER BY ' + order if order else ''} {frame})"


NUMBERED = """numbered AS (
  SELECT o_orderkey AS id, o_custkey AS customerId, CAST(o_orderdate AS DATE) AS created,
         o_orderpriority AS channel, o_orderstatus AS sourceName,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
           AS order_number_for_customer
  FROM orders)"""

LINES = (
    NUMBERED
    + """,
lines AS (
  SELECT n.*, l_partkey AS productId, l_quantity AS quantity, l_returnflag AS flag,
         p_type, p_brand
  FROM numbered n JOIN lineitem ON l_orderkey = id JOIN part ON p_partkey = l_partkey)"""
)

EVENTS = """event_days AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS startDate FROM orders
  WHERE day(o_orderdate) = 15 AND month(o_orderdate) IN (3, 6, 9, 12))"""


def spends(key: str | None = None) -> str:
    revenue = "l_extendedprice * (1 - l_discount)"
    return f"""spends AS (
  SELECT {key_list(key)}CAST(l_shipdate AS DATE) AS date,
    round(sum(l_extendedprice * l_discount), 4) AS adSpend,
    round(sum(CASE WHEN l_returnflag = 'R' THEN {revenue} ELSE 0 END), 4) AS rcRevenue,
    round(sum({revenue}), 4) AS totalRevenue,
    CAST(sum(l_quantity) AS BIGINT) AS totalMerchSold,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT)
      AS totalNewCustomerBarsSold,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT)
      AS totalRecurringCustomerBarsSold
  FROM lineitem JOIN part ON p_partkey = l_partkey
  GROUP BY ALL)"""


def combined(key: str | None = None) -> str:
    on = f"({key_list(key)}created)"
    return (
        LINES
        + ",\n"
        + EVENTS
        + ",\n"
        + spends(key)
        + f""",
daily AS (
  SELECT {key_list(key)}created, count(*) AS orders,
    count(DISTINCT customerId) AS unique_customers,
    count(DISTINCT CASE WHEN order_number_for_customer = 1 THEN customerId END) AS new_customers
  FROM lines GROUP BY ALL),
combined AS (
  SELECT {key_list(key)}created, coalesce(orders, 0)::BIGINT AS orders,
    {", ".join(MONEY + UNITS)},
    CAST(isodow(created) - 1 AS INT) AS created_weekday,
    CAST(month(created) AS INT) AS created_month,
    coalesce(unique_customers, 0)::BIGINT AS unique_customers,
    coalesce(new_customers, 0)::BIGINT AS new_customers,
    CAST(created IN (SELECT startDate FROM event_days) AS INT) AS event_start
  FROM daily FULL JOIN (SELECT * RENAME (date AS created) FROM spends) s USING {on})"""
    )


def trimmed(key: str | None = None) -> str:
    return (
        combined(key)
        + f""",
trimmed AS (
  SELECT * FROM combined
  QUALIFY row_number() {over(key, "created DESC")} > 1)"""
    )


def completed(key: str | None = None, source: str = "trimmed") -> str:
    group = f"GROUP BY {key}" if key else ""
    return (
        trimmed(key)
        + f""",
days AS (
  SELECT {key_list(key)}unnest(generate_series(min(created)::TIMESTAMP,
    max(created)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS created
  FROM {source} {group}),
completed AS (
  SELECT * FROM days LEFT JOIN {source} USING ({key_list(key)}created))"""
    )


def panel(key: str | None = None) -> str:
    whole = over(key)
    line = over(key, "created")
    filled = ",\n    ".join(
        f"coalesce({c}::DOUBLE, quantile_cont({c}::DOUBLE, 0.5) {whole}, 0.0) AS {c}" for c in PANEL
    )
    lagged = ",\n    ".join(
        f"lag({c}, {k}) {line} AS {c}_lag_{k}" for k in (1, 7, 30) for c in ("adSpend", "orders")
    )

    def growth(c):
        before = f"lag({c}) {line}"
        return f"({c} - {before}) / nullif({before}, 0)"

    derived = ",\n    ".join(
        f"coalesce({c}, quantile_cont({c}, 0.5) {whole}, 0.0) AS {c}" for c in (*LAGS, *GROWTH)
    )
    return (
        completed(key)
        + f""",
filled AS (
  SELECT {key_list(key)}created,
    {filled},
    sin(2 * pi() * (isodow(created) - 1) / 7) AS created_weekday_sin,
    cos(2 * pi() * (isodow(created) - 1) / 7) AS created_weekday_cos,
    sin(2 * pi() * month(created) / 12) AS created_month_sin,
    cos(2 * pi() * month(created) / 12) AS created_month_cos
  FROM completed),
lagged AS (
  SELECT * REPLACE (floor(event_start) AS event_start),
    {lagged},
    {growth("totalRevenue")} AS revenue_growth,
    {growth("adSpend")} AS investment_growth,
    coalesce(lead(floor(event_start)) {line}, 0.0) AS event_start_next_1
  FROM filled),
panel AS (
  SELECT {key_list(key)}created, {", ".join((*PANEL, *CYCLES))},
    {derived},
    event_start_next_1
  FROM lagged)"""
    )


def series(key: str | None = None) -> str:
    join = "JOIN part ON p_partkey = l_partkey" if key else ""
    return f"""series AS (
  SELECT {key_list(key)}CAST(o_orderdate AS DATE) AS created, count(*)::DOUBLE AS y
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey {join} GROUP BY ALL)"""


def components(key: str | None = None, days: int = 7, weeks: int = 8) -> str:
    frame = "RANGE BETWEEN INTERVAL {} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"
    by_weekday = f"{key_list(key)}isodow(created)"
    return f"""components AS (
  SELECT *,
    avg(y) {over(key, "created", frame.format(days))} AS trailing_mean_7,
    quantile_cont(y, 0.5) {over(by_weekday, "created", frame.format(7 * weeks))}
      AS same_weekday_median_8w
  FROM series)"""


def backtest(key: str | None = None) -> str:
    whole = over(key)
    return (
        series(key)
        + ",\n"
        + components(key)
        + f""",
backtest AS (
  SELECT {key_list(key)}row_number() {over(key, "created")} - 1 AS sample_idx, created,
    y AS y_true, trailing_mean_7, same_weekday_median_8w,
    coalesce(0.45::DOUBLE * trailing_mean_7 + 0.55::DOUBLE * same_weekday_median_8w,
      trailing_mean_7, same_weekday_median_8w) AS y_pred
  FROM (SELECT *, min(created) {whole} AS d0, max(created) {whole} AS d1 FROM components)
  WHERE created >= d0 + CAST(trunc((d1 - d0 + 1) * {TRAIN}) AS INT))"""
    )


VARIANTS = {
    "baseline_tm7_sw8_blend": "y_pred",
    "trailing_mean_7": "trailing_mean_7",
    "same_weekday_median_8w": "same_weekday_median_8w",
}


def errors(key: str | None = BRAND) -> str:
    parts = "\n  UNION ALL ".join(
        f"SELECT '{m}' AS model, {key_list(key)}sample_idx, y_true, {c} AS y_pred, "
        f"abs(y_true - {c}) / greatest(abs(y_true), 1e-8) AS mape, created "
        f"FROM backtest WHERE {c} IS NOT NULL"
        for m, c in VARIANTS.items()
    )
    return backtest(key) + f",\nerrs AS (\n  {parts})"


METRICS = """avg(abs(y_true - y_pred)) AS mae,
    sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, avg(mape) AS mape"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"

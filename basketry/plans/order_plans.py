"""Registered order queries (A, E, F1-F8, J2) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import orders as O
from basketry.operators import periods as P
from basketry.operators.joins import split_join
from basketry.plans.registry import register
from basketry.schemas import require_columns
from basketry.sources.adapters import landed_order_base, landed_order_items

STATUS = "F"              # the preferred ("complete") status in this data
THRESHOLD = 250_000.0     # order total threshold; every total exceeds 100 here


def _items(spark, sf):
    return landed_order_items(spark, sf)


def _base(spark, sf):
    return landed_order_base(spark, sf, STATUS)


def _metrics(spark, sf):
    return O.order_metrics_by_period_type(None, threshold=THRESHOLD, base=_base(spark, sf))


@register("status_filter", """
SELECT * FROM order_items WHERE orderStatus = 'F'
""")
def q_status_filter(spark, sf):
    return O.status_filter(_items(spark, sf), STATUS)


@register("summarize_orders", """
SELECT CAST(count(*) AS BIGINT) AS num_orders,
       coalesce(CAST(sum(orderTotal) AS DOUBLE), 0.0) AS total_revenue,
       coalesce(sum(qty), 0.0) AS total_items,
       CAST(count(DISTINCT customerId) AS BIGINT) AS unique_customers
FROM order_items
""")
def q_summarize_orders(spark, sf):
    return O.summarize_orders(_items(spark, sf))


@register("aggregate_orders", """
SELECT customerType,
       coalesce(CAST(sum(orderTotal) AS DOUBLE), 0.0) AS orderTotal_sum,
       CAST(sum(orderTotal) AS DOUBLE) / count(orderTotal) AS orderTotal_mean,
       CAST(count(orderTotal) AS BIGINT) AS orderTotal_count,
       coalesce(sum(qty), 0.0) AS qty,
       CAST(count(DISTINCT orderId) AS BIGINT) AS orderId
FROM order_items WHERE customerType IS NOT NULL
GROUP BY customerType
""")
def q_aggregate_orders(spark, sf):
    return O.aggregate_orders(_items(spark, sf), ["customerType"],
                              {"orderTotal": ["sum", "mean", "count"], "qty": "sum",
                               "orderId": "nunique"})


@register("orders_at_order_level", """
SELECT * FROM order_level
""")
def q_orders_at_order_level(spark, sf):
    return O.orders_at_order_level(_items(spark, sf))


@register("aov_by_type_period", """
SELECT periodStart, customerType,
       CAST(count(DISTINCT orderId) AS BIGINT) AS orders,
       CAST(sum(orderSubTotal) AS DOUBLE) / count(orderSubTotal) AS avg_order_subtotal,
       CAST(sum(orderTotal) AS DOUBLE) / count(orderTotal) AS avg_order_total,
       coalesce(CAST(sum(orderSubTotal) AS DOUBLE), 0.0) AS sum_order_subtotal,
       coalesce(CAST(sum(orderTotal) AS DOUBLE), 0.0) AS sum_order_total
FROM order_level GROUP BY periodStart, customerType
""")
def q_aov_by_type_period(spark, sf):
    return O.aov_by_type_period(_items(spark, sf))


@register("order_metrics_by_period_type", """
SELECT * FROM order_metrics
""")
def q_order_metrics(spark, sf):
    return _metrics(spark, sf)


def _kpi_sql(disp: str, selected: str) -> str:
    """KPIs over the rows ``disp``; ``selected`` gives the selector's periods."""
    return f"""
WITH shown AS ({disp}), chosen AS ({selected}),
e AS (SELECT DISTINCT email FROM shown WHERE email IS NOT NULL),
h AS (SELECT e.email, cust_hist.first_period, cust_hist.avg_weeks FROM e LEFT JOIN cust_hist USING (email))
SELECT coalesce(CAST(sum(orderTotal) AS DOUBLE), 0.0) AS revenue,
       CAST(count(orderId) AS BIGINT) AS total_orders,
       CASE WHEN count(orderId) = 0 THEN 0.0
            ELSE coalesce(CAST(sum(orderTotal) AS DOUBLE), 0.0) / count(orderId) END AS aov,
       CASE WHEN count(orderId) = 0 THEN 0.0
            ELSE count_if(orderTotal > 250000) * 100.0 / count(orderId) END AS pct_orders_over,
       (SELECT CAST(count(*) AS BIGINT) FROM h WHERE first_period IN (SELECT periodStart FROM chosen)) AS new_customers,
       (SELECT CASE WHEN count(*) = 0 THEN 0.0
                    ELSE count_if(first_period < (SELECT min(periodStart) FROM chosen)) * 100.0 / count(*) END
          FROM h) AS recurring_pct,
       (SELECT CAST(sum(CAST(avg_weeks AS DECIMAL(38,9))) AS DOUBLE) / count(avg_weeks) FROM h) AS avg_weeks_between
FROM shown
"""


_ALL_PERIODS = "SELECT DISTINCT periodStart FROM order_base WHERE periodStart IS NOT NULL"


@register("order_kpis", _kpi_sql("SELECT * FROM disp", _ALL_PERIODS))
def q_order_kpis(spark, sf):
    return O.order_kpis(None, threshold=THRESHOLD, base=_base(spark, sf))


# a selection of periods and one of customer types
SELECT_FROM = "1997-01-01"
SELECT_TYPES = ["BUILDING", "MACHINERY"]
_SELECTED = f"SELECT DISTINCT periodStart FROM order_base WHERE periodStart >= DATE '{SELECT_FROM}'"
_SHOWN = f"""SELECT * FROM disp WHERE periodStart >= DATE '{SELECT_FROM}'
  AND customerType IN ({", ".join(f"'{t}'" for t in SELECT_TYPES)})"""


def _selected_periods(base):
    return base.select("periodStart").where(F.col("periodStart") >= F.lit(SELECT_FROM).cast("date"))


@register("order_kpis_selected", _kpi_sql(_SHOWN, _SELECTED))
def q_order_kpis_selected(spark, sf):
    base = _base(spark, sf)
    return O.order_kpis(None, threshold=THRESHOLD, periods=_selected_periods(base), types=SELECT_TYPES, base=base)


def _detail_sql(disp: str) -> str:
    return f"""
SELECT d.email, arg_min(d.customerName, d.orderId) AS name,
       d.customerType AS customer_type, d.periodStart AS first_period
FROM ({disp}) d JOIN cust_hist h ON d.email = h.email AND h.first_period = d.periodStart
GROUP BY d.email, d.customerType, d.periodStart
"""


@register("new_customers_detail", _detail_sql("SELECT * FROM disp"))
def q_new_customers_detail(spark, sf):
    return O.new_customers_detail(None, base=_base(spark, sf))


@register("new_customers_selected", _detail_sql(_SHOWN))
def q_new_customers_selected(spark, sf):
    base = _base(spark, sf)
    return O.new_customers_detail(None, periods=_selected_periods(base), types=SELECT_TYPES, base=base)


@register("metrics_grid", """
SELECT strftime(period_start, '%m/%d/%y') AS period_start, customer_type, round_even(revenue, 2) AS revenue, total_orders,
       round_even(aov, 2) AS aov, round_even(pct_orders_over, 1) AS pct_orders_over, new_customers,
       round_even(recurring_pct, 1) AS recurring_pct, round_even(avg_weeks, 1) AS avg_weeks
FROM order_metrics
""")
def q_metrics_grid(spark, sf):
    return O.metrics_grid(_metrics(spark, sf))


# -- customer history (E1-E3, J2) -------------------------------------------

@register("customer_first_order", """
SELECT email, first_period FROM cust_hist
""")
def q_customer_first_order(spark, sf):
    return O.customer_history(_base(spark, sf)).select("email", "first_period")


@register("recurring_customers", """
SELECT DISTINCT b.email, b.periodStart AS period_start,
       h.first_period < b.periodStart AS is_recurring
FROM order_base b JOIN cust_hist h ON b.email = h.email
WHERE b.periodStart IS NOT NULL
""")
def q_recurring_customers(spark, sf):
    base = _base(spark, sf)
    hist = O.customer_history(base)
    return (base.where(F.col("periodStart").isNotNull() & F.col("email").isNotNull())
            .select("email", "periodStart").distinct()
            .join(hist, "email")
            .select("email", F.col("periodStart").alias("period_start"),
                    (F.col("first_period") < F.col("periodStart")).alias("is_recurring")))


@register("avg_weeks_between_orders", """
SELECT email, CAST(n_periods AS BIGINT) AS n_periods, avg_weeks FROM cust_hist
""")
def q_avg_weeks(spark, sf):
    return O.customer_history(_base(spark, sf)) \
        .select("email", "n_periods", "avg_weeks")


@register("customer_history_lookup", """
SELECT b.orderId, b.email, b.periodStart, h.first_period,
       coalesce(h.first_period < b.periodStart, false) AS is_recurring, h.avg_weeks
FROM order_base b LEFT JOIN cust_hist h ON b.email = h.email
""")
def q_customer_history_lookup(spark, sf):
    base = _base(spark, sf)
    hist = O.customer_history(base)
    # one row an e-mail in the history: hot e-mails are split off, rows without one don't move
    rows = split_join(base, hist, "email", "left")
    return rows.select("orderId", "email", "periodStart", "first_period",
                       F.coalesce(F.col("first_period") < F.col("periodStart"), F.lit(False))
                       .alias("is_recurring"), "avg_weeks")


# -- comparisons (E4-E6) ----------------------------------------------------

def _comparison_sql(label: str, prev: str, spine: str) -> str:
    cols = ["revenue", "total_orders", "aov", "pct_orders_over", "new_customers", "recurring_pct"]
    # ratios are added up in a fixed order, as doubles
    sums = ", ".join("CAST(sum(CAST(revenue AS DECIMAL(38,2))) AS DOUBLE) AS revenue" if c == "revenue"
                     else f"sum({c} ORDER BY period_start, customer_type) AS {c}" if c in P.RATIO_METRICS
                     else f"CAST(sum({c}) AS BIGINT) AS {c}" for c in cols)
    fill = ", ".join(f"coalesce(b.{c}, 0) AS {c}" for c in cols)
    pct = ", ".join(
        f"CASE WHEN p.{c} IS NULL THEN NULL WHEN p.{c} = 0 AND c.{c} = 0 THEN NULL "
        f"WHEN p.{c} = 0 AND c.{c} > 0 THEN CAST('Infinity' AS DOUBLE) "
        f"WHEN p.{c} = 0 THEN CAST('-Infinity' AS DOUBLE) "
        f"ELSE (CAST(c.{c} AS DOUBLE) / p.{c} - 1.0) * 100.0 END AS {c}_pct" for c in cols)
    return f"""
WITH binned AS (SELECT {label} AS period_label, {sums} FROM order_metrics GROUP BY 1),
spine AS (SELECT {spine} AS period_label FROM binned),
filled AS (SELECT s.period_label, {fill} FROM spine s LEFT JOIN binned b USING (period_label))
SELECT c.*, {pct}
FROM filled c LEFT JOIN filled p ON p.period_label = {prev}
"""


@register("week_over_week", _comparison_sql(
    "CAST(date_trunc('week', period_start) AS DATE) + 6",
    "c.period_label - 7",
    "CAST(unnest(generate_series(CAST(min(period_label) AS TIMESTAMP), "
    "CAST(max(period_label) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE)"))
def q_week_over_week(spark, sf):
    return P.period_comparison(_metrics(spark, sf), "W")


@register("month_over_month", _comparison_sql(
    "last_day(period_start)",
    "last_day(CAST(c.period_label - INTERVAL 1 MONTH AS DATE))",
    "last_day(CAST(unnest(generate_series(CAST(date_trunc('month', min(period_label)) AS TIMESTAMP), "
    "CAST(date_trunc('month', max(period_label)) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE))"))
def q_month_over_month(spark, sf):
    return P.period_comparison(_metrics(spark, sf), "ME")


@register("year_over_year", _comparison_sql(
    "make_date(year(period_start), 12, 31)",
    "make_date(year(c.period_label) - 1, 12, 31)",
    "make_date(CAST(unnest(generate_series(year(min(period_label)), year(max(period_label)))) "
    "AS INTEGER), 12, 31)"))
def q_year_over_year(spark, sf):
    return P.period_comparison(_metrics(spark, sf), "YE")


# -- filters and the period dimension (F1, F4-F8) ----------------------------

@register("rolling_date_window", """
SELECT * FROM order_items
WHERE CAST(periodStart AS TIMESTAMP) >= TIMESTAMP '1996-06-30 00:00:00' - INTERVAL 730 DAY
  AND CAST(periodStart AS TIMESTAMP) <= TIMESTAMP '1996-06-30 00:00:00'
""")
def q_rolling_date_window(spark, sf):
    return P.rolling_date_window(_items(spark, sf), "periodStart", last_days=730)


REQUIRED_ORDER_VALUE = ["orderId", "periodStart", "customerType", "orderSubTotal", "orderTotal"]


@register("required_columns", f"""
SELECT {", ".join(REQUIRED_ORDER_VALUE)} FROM order_items
""")
def q_required_columns(spark, sf):
    """Schema guard: fails naming the missing columns, else projects them."""
    return require_columns(_items(spark, sf), REQUIRED_ORDER_VALUE).select(*REQUIRED_ORDER_VALUE)


_PERIOD_DIM_SQL = """
SELECT DISTINCT periodStart, CAST(year(periodStart) AS INTEGER) AS year,
       CAST(date_trunc('month', periodStart) AS DATE) AS month_start,
       CAST(isoyear(periodStart) AS INTEGER) AS iso_year,
       CAST(week(periodStart) AS INTEGER) AS iso_week,
       CAST(isoyear(periodStart) AS VARCHAR) || '-W' || lpad(CAST(week(periodStart) AS VARCHAR), 2, '0')
           AS week_key
FROM order_base WHERE periodStart IS NOT NULL
"""


@register("period_dimension", _PERIOD_DIM_SQL)
def q_period_dimension(spark, sf):
    return P.period_dimension(_base(spark, sf))


SEL_YEARS = [1996, 1997]
SEL_MONTHS = ["1996-01-01", "1996-02-01", "1996-03-01", "1997-03-01", "1997-04-01"]
SEL_WEEKS = ["1996-W02", "1996-W03", "1996-W05", "1996-W09", "1996-W12", "1997-W10",
             "1997-W11", "1997-W14", "1997-W16"]
SEL_TYPES = ["AUTOMOBILE", "BUILDING", "MACHINERY"]


@register("period_hierarchy_filter", f"""
WITH dim AS ({_PERIOD_DIM_SQL}),
sel AS (SELECT periodStart FROM dim
        WHERE year IN ({", ".join(map(str, SEL_YEARS))})
          AND month_start IN ({", ".join(f"DATE '{m}'" for m in SEL_MONTHS)})
          AND week_key IN ({", ".join(f"'{w}'" for w in SEL_WEEKS)}))
SELECT * FROM order_base
WHERE periodStart IN (SELECT periodStart FROM sel)
  AND customerType IN ({", ".join(f"'{t}'" for t in SEL_TYPES)})
""")
def q_period_hierarchy_filter(spark, sf):
    base = _base(spark, sf)
    sel = P.period_hierarchy_filter(P.period_dimension(base), SEL_YEARS, SEL_MONTHS, SEL_WEEKS)
    return O.display_rows(base, sel, SEL_TYPES)


@register("distinct_options", r"""
SELECT DISTINCT regexp_replace(regexp_replace(customerType, '^\s+', ''), '\s+$', '') AS customerType
FROM order_items WHERE customerType IS NOT NULL
""")
def q_distinct_options(spark, sf):
    from basketry.operators.products import distinct_options
    from basketry.functions.cleaning import strip_ws
    items = _items(spark, sf).withColumn("customerType", strip_ws("customerType"))
    return distinct_options(items, "customerType")

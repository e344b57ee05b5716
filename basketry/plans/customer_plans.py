"""Registered customer, segment and CLV queries (C, F9-F12, J1, J3, T1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import customers as C
from basketry.plans.registry import register
from basketry.sources.adapters import landed_customers, landed_order_items, landed_segments

SEGMENT = "Champions"       # segment inspected by the drill-down and order queries
CLV_MONTHS = 12

_REC_COLS = ("customerId, fullName, email, custType, locName, plName, totalOrders, totalSales, "
             "firstOrder, lastOrder, dateEntered, days_since_last_order, customer_age_days")


def _seg(spark, sf):
    return landed_segments(spark, sf)


def _clv(spark, sf):
    return C.customer_clv(_seg(spark, sf), CLV_MONTHS)


def _seg_orders(spark, sf):
    return C.segment_orders_semi_join(landed_order_items(spark, sf), _seg(spark, sf), SEGMENT)


@register("customer_recency", f"SELECT {_REC_COLS} FROM cust_rec")
def q_customer_recency(spark, sf):
    return C.customer_recency(landed_customers(spark, sf))


@register("rfm_thresholds", "SELECT CAST(n_active AS BIGINT) AS n_active, r_p33, f_p66, m_p66 FROM rfm_thr")
def q_rfm_thresholds(spark, sf):
    rec = C.customer_recency(landed_customers(spark, sf))
    t = C.rfm_thresholds(rec)
    # one row derived from the data: the active count, plus the thresholds
    return C._active(rec).agg(F.count(F.lit(1)).cast("long").alias("n_active")).select(
        "n_active", F.lit(t.r_p33).cast("double").alias("r_p33"),
        F.lit(t.f_p66).cast("double").alias("f_p66"),
        F.lit(t.m_p66).cast("double").alias("m_p66"))


@register("segment_customers", f"SELECT {_REC_COLS}, segment FROM cust_seg")
def q_segment_customers(spark, sf):
    return _seg(spark, sf)


@register("segment_kpis", """
SELECT CAST(count(*) AS BIGINT) AS total_customers,
       CAST(count_if(segment IN ('Champions', 'Loyal')) AS BIGINT) AS champions_loyal,
       CAST(count_if(segment = 'At-Risk') AS BIGINT) AS at_risk,
       CAST(count_if(segment = 'Lost') AS BIGINT) AS lost,
       CAST(count_if(segment = 'New') AS BIGINT) AS new,
       CASE WHEN count(*) = 0 THEN NULL
            ELSE count_if(segment IN ('Champions', 'Loyal')) * 100.0 / count(*) END
           AS champions_loyal_pct
FROM cust_seg
""")
def q_segment_kpis(spark, sf):
    return C.segment_kpis(_seg(spark, sf))


def _action_case(col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'"
                     for k, v in C.SEGMENT_ACTIONS.items())
    return f"CASE {whens} ELSE '' END"


@register("segment_profile", f"""
SELECT coalesce(segment, 'Unknown') AS segment,
       CAST(count(totalOrders) AS BIGINT) AS customers,
       avg(CAST(totalSales AS DOUBLE)) AS avg_total_sales,
       avg(CAST(totalOrders AS DOUBLE)) AS avg_total_orders,
       avg(CAST(days_since_last_order AS DOUBLE)) AS avg_days_since_last,
       {_action_case("coalesce(segment, 'Unknown')")} AS suggested_action
FROM cust_seg GROUP BY segment
""")
def q_segment_profile(spark, sf):
    return C.segment_profile(_seg(spark, sf))


@register("segment_action_lookup", f"""
SELECT customerId, segment, {_action_case("segment")} AS suggested_action FROM cust_seg
""")
def q_segment_action_lookup(spark, sf):
    return _seg(spark, sf).select("customerId", "segment",
                                  C.action_for(F.col("segment")).alias("suggested_action"))


@register("segment_drilldown", f"""
SELECT customerId, fullName, email, custType, locName, plName, totalOrders, totalSales,
       days_since_last_order, strftime(firstOrder, '%Y-%m-%d') AS firstOrder,
       strftime(lastOrder, '%Y-%m-%d') AS lastOrder
FROM cust_seg WHERE segment = '{SEGMENT}'
""")
def q_segment_drilldown(spark, sf):
    return C.segment_drilldown(_seg(spark, sf), SEGMENT)


_CAND = "customerId, fullName, email, custType, totalOrders, totalSales, days_since_last_order"


@register("lookalike_regular_to_loyal", f"""
SELECT {_CAND} FROM cust_seg
WHERE segment = 'Regular' AND totalSales >= (
  SELECT quantile_cont(totalSales, 0.25) FROM cust_seg WHERE segment IN ('Loyal', 'Champions'))
""")
def q_lookalike_regular_to_loyal(spark, sf):
    return C.lookalike_regular_to_loyal(_seg(spark, sf))


@register("lookalike_winback_at_risk", f"""
SELECT {_CAND} FROM cust_seg
WHERE segment = 'At-Risk' AND totalSales >= coalesce(
  (SELECT quantile_cont(totalSales, 0.5) FROM cust_seg WHERE segment = 'At-Risk'), 0.0)
""")
def q_lookalike_winback_at_risk(spark, sf):
    return C.lookalike_winback_at_risk(_seg(spark, sf))


@register("lookalike_occasional_recent", f"""
SELECT {_CAND} FROM cust_seg
WHERE segment = 'Occasional' AND coalesce(days_since_last_order, 999) < 90
""")
def q_lookalike_occasional_recent(spark, sf):
    return C.lookalike_occasional_recent(_seg(spark, sf))


# -- orders of a segment ------------------------------------------------------

@register("segment_orders_semi_join", "SELECT * FROM seg_orders")
def q_segment_orders_semi_join(spark, sf):
    return _seg_orders(spark, sf)


@register("segment_order_insights", """
SELECT CAST(count(DISTINCT orderId) AS BIGINT) AS orders,
       CAST(sum(orderTotal) AS DOUBLE) / count(orderTotal) AS avg_order_value,
       coalesce(CAST(sum(orderTotal) AS DOUBLE), 0.0) AS total_revenue
FROM (SELECT orderId, max(orderTotal) AS orderTotal FROM seg_orders
      WHERE orderId IS NOT NULL GROUP BY orderId)
""")
def q_segment_order_insights(spark, sf):
    return C.segment_order_insights(_seg_orders(spark, sf))


@register("segment_monthly_revenue", """
SELECT month, revenue FROM (
  SELECT strftime(periodStart, '%Y-%m') AS month,
         coalesce(CAST(sum(orderTotal) AS DOUBLE), 0.0) AS revenue
  FROM (SELECT orderId, max(periodStart) AS periodStart, max(orderTotal) AS orderTotal
        FROM seg_orders WHERE orderId IS NOT NULL GROUP BY orderId)
  WHERE periodStart IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 24)
""")
def q_segment_monthly_revenue(spark, sf):
    return C.segment_monthly_revenue(_seg_orders(spark, sf))


@register("top_products_segment", """
SELECT productName, coalesce(sum(qty), 0.0) AS units FROM seg_orders
WHERE productName IS NOT NULL GROUP BY productName
ORDER BY units DESC, productName LIMIT 10
""")
def q_top_products_segment(spark, sf):
    return C.top_products_segment(_seg_orders(spark, sf))


# -- CLV ---------------------------------------------------------------------

_CLV_COLS = (_REC_COLS + ", segment, historical_clv, avg_order_value, orders_per_month, "
             "projected_clv")


@register("calculate_clv", f"SELECT {_CLV_COLS} FROM cust_clv0")
def q_calculate_clv(spark, sf):
    return C.calculate_clv(_seg(spark, sf), CLV_MONTHS).drop("_orders")


@register("clv_tiers", "SELECT customerId, segment, projected_clv, clv_tier FROM cust_clv")
def q_clv_tiers(spark, sf):
    return _clv(spark, sf).select("customerId", "segment", "projected_clv", "clv_tier")


@register("clv_kpis", """
SELECT coalesce(sum(projected_clv), 0.0) AS portfolio_projected_clv,
       avg(projected_clv) AS avg_clv,
       CAST(count_if(clv_tier = 'High') AS BIGINT) AS high_tier_customers,
       coalesce(sum(historical_clv), 0.0) AS total_historical_clv,
       quantile_cont(projected_clv, 0.5) AS median_clv
FROM cust_clv WHERE totalOrders > 0
""")
def q_clv_kpis(spark, sf):
    return C.clv_kpis(_clv(spark, sf))


@register("clv_by_segment", """
SELECT segment, avg(projected_clv) AS avg_clv, sum(projected_clv) AS total_clv,
       CAST(count(projected_clv) AS BIGINT) AS customers
FROM cust_clv WHERE totalOrders > 0 GROUP BY segment
""")
def q_clv_by_segment(spark, sf):
    return C.clv_by_segment(_clv(spark, sf))


@register("clv_segment_summary", """
SELECT segment, CAST(count(projected_clv) AS BIGINT) AS customers,
       avg(historical_clv) AS avg_historical_clv, avg(projected_clv) AS avg_projected_clv,
       sum(projected_clv) AS total_projected_clv, avg(avg_order_value) AS avg_aov,
       avg(orders_per_month) AS avg_orders_per_month
FROM cust_clv WHERE totalOrders > 0 GROUP BY segment
""")
def q_clv_segment_summary(spark, sf):
    return C.clv_segment_summary(_clv(spark, sf))


@register("clv_histogram", """
WITH a AS (SELECT * FROM cust_clv WHERE totalOrders > 0),
r AS (SELECT min(projected_clv) AS lo, max(projected_clv) AS hi FROM a),
b AS (SELECT a.clv_tier,
             CASE WHEN r.hi = r.lo THEN 1
                  ELSE least(CAST(floor((a.projected_clv - r.lo) / (r.hi - r.lo) * 40) AS INTEGER) + 1, 40)
             END AS bin, r.lo, r.hi
      FROM a CROSS JOIN r)
SELECT clv_tier, bin, lo + (bin - 1) * ((hi - lo) / 40) AS bin_start,
       lo + bin * ((hi - lo) / 40) AS bin_end, CAST(count(*) AS BIGINT) AS customers
FROM b GROUP BY clv_tier, bin, lo, hi
""")
def q_clv_histogram(spark, sf):
    return C.clv_histogram(_clv(spark, sf))


@register("aov_vs_frequency", """
SELECT customerId, fullName, orders_per_month, avg_order_value, historical_clv, projected_clv,
       clv_tier, segment, totalOrders, totalSales
FROM cust_clv WHERE totalOrders > 0
""")
def q_aov_vs_frequency(spark, sf):
    return C.aov_vs_frequency(_clv(spark, sf))


@register("clv_table", """
SELECT customerId, fullName, email, custType, segment, clv_tier, historical_clv, projected_clv,
       avg_order_value, orders_per_month, totalOrders, days_since_last_order
FROM cust_clv
""")
def q_clv_table(spark, sf):
    return C.clv_table(_clv(spark, sf))

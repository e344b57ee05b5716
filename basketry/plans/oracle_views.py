"""DuckDB SQL for the adapter views and shared intermediate steps.

These are the oracle side of the correctness check: the same tables the
Spark adapters derive, written independently in SQL. ``with_views`` prefixes
a query with every view it needs (dependencies resolved in order).
"""

from __future__ import annotations

import re

AS_OF_SQL = "TIMESTAMP '1996-06-30 00:00:00'"

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


view("order_items", """
SELECT coalesce(o.o_orderkey, l.l_orderkey) AS orderId,
       CAST(l.l_linenumber AS BIGINT) AS itemOrder,
       CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
            ELSE CAST(date_trunc('week', o.o_orderdate) AS DATE) END AS periodStart,
       CASE WHEN c.c_custkey % 7 = 0 THEN '  ' || c.c_mktsegment || ' '
            ELSE c.c_mktsegment END AS customerType,
       CASE WHEN l.rn = 1 THEN l.sub END AS orderSubTotal,
       CASE WHEN l.rn = 1 OR l.l_orderkey IS NULL THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END AS orderTotal,
       o.o_orderstatus AS orderStatus,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL
            ELSE upper('c' || CAST(c.c_custkey AS VARCHAR) || '@example.com') END AS email,
       c.c_custkey AS customerId,
       c.c_name AS customerName,
       n.n_name AS locationName,
       CAST(l.l_quantity AS DOUBLE) AS qty,
       p.p_name AS productName,
       CASE WHEN s.s_suppkey % 13 = 0 THEN NULL ELSE s.s_name END AS producerName
FROM (SELECT *,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_suppkey DESC,
                 l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC,
                 l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC) AS rn,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey)
                  AS DECIMAL(18,2)) AS sub
      FROM lineitem) l
FULL JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
""")

view("customers", f"""
SELECT c.c_custkey AS customerId,
       c.c_name AS fullName,
       lower('c' || CAST(c.c_custkey AS VARCHAR) || '@example.com') AS email,
       c.c_mktsegment AS custType,
       n.n_name AS locName,
       r.r_name AS plName,
       CAST(coalesce(s.n, 0) AS BIGINT) AS totalOrders,
       CAST(s.sales AS DOUBLE) AS totalSales,
       s.first_o AS firstOrder,
       s.last_o AS lastOrder,
       s.first_o AS dateEntered
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n,
                  sum(CAST(o_totalprice AS DECIMAL(18,2))) AS sales,
                  min(o_orderdate) AS first_o, max(o_orderdate) AS last_o
           FROM orders WHERE o_orderdate <= {AS_OF_SQL}
           GROUP BY o_custkey) s ON c.c_custkey = s.o_custkey
""")

view("price_levels", """
SELECT CAST(r_regionkey AS INTEGER) AS id, r_name AS name,
       CAST(r_regionkey * 0.05 AS DOUBLE) AS markup, r_regionkey = 0 AS "default"
FROM region
""")

view("availability", """
SELECT CAST(n.n_regionkey AS INTEGER) AS priceLevel,
       CAST(date_trunc('week', o.o_orderdate) AS DATE) AS periodStart,
       CASE WHEN s.s_suppkey % 13 = 0 THEN NULL ELSE s.s_name END AS producer,
       p.p_name AS productName,
       sum(l.l_quantity) AS quantityListed,
       coalesce(sum(CASE WHEN l.l_linestatus = 'F' THEN l.l_quantity END), 0.0) AS quantitySold,
       sum(l.l_quantity) - coalesce(sum(CASE WHEN l.l_linestatus = 'F' THEN l.l_quantity END), 0.0)
           AS quantityAvailable
FROM lineitem l
LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY 1, 2, 3, 4
""")

_ORDER_FIELDS = ["periodStart", "customerType", "orderSubTotal", "orderTotal", "orderStatus", "email",
                 "customerId", "customerName", "locationName"]
_FIRST = {c: f"first({c} ORDER BY coalesce(itemOrder, 0), {c}) FILTER (WHERE {c} IS NOT NULL)"
          for c in _ORDER_FIELDS}

# order level rows: each field's first non-null value in the order of the items
view("order_level", f"""
SELECT orderId, {", ".join(f"{x} AS {c}" for c, x in _FIRST.items())}
FROM order_items WHERE orderId IS NOT NULL GROUP BY orderId
""")

# status 'F', customer type stripped of all whitespace
view("order_base", rf"""
SELECT * REPLACE (regexp_replace(regexp_replace(customerType, '^\s+', ''), '\s+$', '') AS customerType)
FROM (SELECT orderId, {", ".join(f"{x} AS {c}" for c, x in _FIRST.items())}
      FROM order_items WHERE orderId IS NOT NULL AND orderStatus = 'F' GROUP BY orderId)
""")

# gaps between neighbouring distinct periods of a customer
view("cust_hist", """
SELECT email, min(periodStart) AS first_period, count(*) AS n_periods,
       CASE WHEN count(gap) > 0 THEN CAST(sum(gap) AS DOUBLE) / 7.0 / count(gap) END AS avg_weeks
FROM (SELECT email, periodStart,
             date_diff('day', lag(periodStart) OVER (PARTITION BY email ORDER BY periodStart), periodStart) AS gap
      FROM (SELECT DISTINCT email, periodStart FROM order_base
            WHERE email IS NOT NULL AND periodStart IS NOT NULL))
GROUP BY email
""")

view("disp", """
SELECT * FROM order_base WHERE periodStart IS NOT NULL AND customerType IS NOT NULL
""")

view("order_metrics", """
SELECT om.period_start, om.customer_type, om.revenue, om.total_orders, om.aov,
       om.pct_orders_over,
       CAST(coalesce(cm.new_customers, 0) AS BIGINT) AS new_customers,
       coalesce(cm.recurring_pct, 0.0) AS recurring_pct,
       cm.avg_weeks
FROM (SELECT periodStart AS period_start, customerType AS customer_type,
             coalesce(CAST(sum(orderTotal) AS DOUBLE), 0.0) AS revenue,
             CAST(count(orderId) AS BIGINT) AS total_orders,
             CASE WHEN count(orderId) = 0 THEN 0.0
                  ELSE coalesce(CAST(sum(orderTotal) AS DOUBLE), 0.0) / count(orderId) END AS aov,
             CASE WHEN count(orderId) = 0 THEN 0.0
                  ELSE count_if(orderTotal > 250000) * 100.0 / count(orderId) END AS pct_orders_over
      FROM disp GROUP BY 1, 2) om
LEFT JOIN (SELECT d.periodStart AS period_start, d.customerType AS customer_type,
                  count_if(h.first_period = d.periodStart) AS new_customers,
                  count_if(h.first_period < d.periodStart) * 100.0 / count(*) AS recurring_pct,
                  CAST(sum(CAST(h.avg_weeks AS DECIMAL(38,9))) AS DOUBLE) / count(h.avg_weeks)
                      AS avg_weeks
           FROM (SELECT DISTINCT periodStart, customerType, email FROM disp
                 WHERE email IS NOT NULL) d
           LEFT JOIN cust_hist h ON d.email = h.email
           GROUP BY 1, 2) cm
  ON om.period_start = cm.period_start AND om.customer_type = cm.customer_type
""")


def _deps(sql: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with WITH clauses for every adapter/intermediate it uses."""
    order: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in order or name in stack:
            return
        for d in _deps(VIEWS[name]):
            if d != name:
                visit(d, stack + (name,))
        order.append(name)

    for n in _deps(sql):
        visit(n)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in order)
    body = sql.strip()
    if re.match(r"(?is)^with\s", body):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


# -- customers ----------------------------------------------------------------

view("cust_rec", f"""
SELECT customerId, fullName, email, custType, locName, plName, totalOrders,
       coalesce(totalSales, 0.0) AS totalSales, firstOrder, lastOrder, dateEntered,
       CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(lastOrder)) / 86400000000.0) AS BIGINT)
           AS days_since_last_order,
       CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(firstOrder)) / 86400000000.0) AS BIGINT)
           AS customer_age_days
FROM customers
""")

view("rfm_thr", """
SELECT count(*) AS n_active,
       quantile_cont(days_since_last_order, 0.33) AS r_p33,
       quantile_cont(totalOrders, 0.66) AS f_p66,
       quantile_cont(totalSales, 0.66) AS m_p66
FROM cust_rec WHERE totalOrders > 0 AND days_since_last_order IS NOT NULL
""")

view("cust_seg", """
SELECT c.*,
  CASE WHEN t.n_active < 5 THEN 'Insufficient Data'
       WHEN c.lastOrder IS NULL OR c.days_since_last_order IS NULL THEN 'Never Ordered'
       WHEN c.customer_age_days IS NOT NULL AND c.customer_age_days <= 90 AND c.totalOrders <= 2
            THEN 'New'
       WHEN c.days_since_last_order > 270 THEN 'Lost'
       WHEN c.days_since_last_order <= t.r_p33 AND c.totalOrders >= t.f_p66
            AND c.totalSales >= t.m_p66 THEN 'Champions'
       WHEN c.totalOrders >= t.f_p66 AND c.totalSales >= t.m_p66
            AND c.days_since_last_order <= 180 THEN 'Loyal'
       WHEN (c.totalSales >= t.m_p66 OR c.totalOrders >= t.f_p66)
            AND c.days_since_last_order > 90 THEN 'At-Risk'
       WHEN c.days_since_last_order <= 90 AND c.totalOrders >= 1 THEN 'Regular'
       ELSE 'Occasional' END AS segment
FROM cust_rec c CROSS JOIN rfm_thr t
""")

view("cust_clv0", """
SELECT *, greatest(avg_order_value * orders_per_month * 12.0, 0.0) AS projected_clv
FROM (SELECT *,
        CASE WHEN totalOrders > 0 THEN historical_clv / totalOrders ELSE 0.0 END AS avg_order_value,
        CASE WHEN coalesce(CAST(customer_age_days AS DOUBLE), 0.0) / 30.44 > 0.5
             THEN totalOrders / (coalesce(CAST(customer_age_days AS DOUBLE), 0.0) / 30.44)
             ELSE 0.0 END AS orders_per_month
      FROM (SELECT *, greatest(totalSales, 0.0) AS historical_clv FROM cust_seg))
""")

view("clv_thr", """
SELECT CASE WHEN count(*) >= 3 THEN quantile_cont(projected_clv, 0.33) ELSE 0.0 END AS p33,
       CASE WHEN count(*) >= 3 THEN quantile_cont(projected_clv, 0.66) ELSE 0.0 END AS p66
FROM cust_clv0 WHERE totalOrders > 0
""")

view("cust_clv", """
SELECT c.*,
  CASE WHEN NOT (c.totalOrders > 0) THEN 'No Orders'
       WHEN c.projected_clv >= t.p66 THEN 'High'
       WHEN c.projected_clv >= t.p33 THEN 'Medium'
       ELSE 'Low' END AS clv_tier
FROM cust_clv0 c CROSS JOIN clv_thr t
""")

# order item rows of the Champions segment (e-mail matched case-insensitively)
view("seg_orders", r"""
SELECT * FROM order_items
WHERE lower(regexp_replace(regexp_replace(coalesce(email, ''), '^\s+', ''), '\s+$', '')) IN (
  SELECT lower(regexp_replace(regexp_replace(email, '^\s+', ''), '\s+$', ''))
  FROM cust_seg WHERE segment = 'Champions' AND email IS NOT NULL)
""")

"""Registered product, producer and availability queries (P, V, F7, T4, T5, J4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import products as P
from basketry.plans.registry import register
from basketry.sources.adapters import (landed_availability, landed_order_items, landed_path,
                                       price_levels)
from basketry.sources.files import availability_source

TOP_K = 5


def _base(spark, sf):
    return P.product_base(landed_order_items(spark, sf))


def _avail_default(spark, sf):
    """Availability of the default price level, producer cleaned."""
    landed_availability(spark, sf)
    path = landed_path(spark, "availability", sf)
    return P.product_base(availability_source(spark, path, price_levels(spark, sf), 0), "producer")


_PBASE = r"""
SELECT orderId, itemOrder, periodStart, customerType, orderSubTotal, orderTotal, orderStatus, email,
       customerId, customerName, locationName, qty, productName,
       regexp_replace(regexp_replace(coalesce(producerName, 'Unknown'), '^\s+', ''), '\s+$', '')
           AS producerName
FROM order_items
"""

_PFILT = f"""
WITH pbase AS ({_PBASE})
"""

_DEFAULT = """
SELECT * FROM pbase
       WHERE producerName IN (SELECT DISTINCT producerName FROM pbase WHERE producerName IS NOT NULL
                              ORDER BY producerName LIMIT 5)
         AND periodStart IN (SELECT DISTINCT periodStart FROM pbase WHERE periodStart IS NOT NULL
                             ORDER BY periodStart DESC LIMIT 12)
"""


@register("product_base", _PBASE)
def q_product_base(spark, sf):
    return _base(spark, sf)


@register("default_product_filter", _PFILT + _DEFAULT)
def q_default_product_filter(spark, sf):
    return P.default_product_filter(_base(spark, sf))


@register("producer_trends", _PFILT + """
SELECT periodStart, producerName, coalesce(sum(qty), 0.0) AS total_qty,
       CAST(count(DISTINCT orderId) AS BIGINT) AS num_orders,
       CAST(count(DISTINCT productName) AS BIGINT) AS num_products
FROM pbase WHERE periodStart IS NOT NULL GROUP BY 1, 2
""")
def q_producer_trends(spark, sf):
    return P.producer_trends(_base(spark, sf))


@register("producer_summary", _PFILT + """
SELECT producerName, CAST(count(DISTINCT productName) AS BIGINT) AS products,
       coalesce(sum(qty), 0.0) AS total_units, avg(qty) AS avg_units_per_order,
       CAST(count(DISTINCT orderId) AS BIGINT) AS num_orders
FROM pbase GROUP BY 1
""")
def q_producer_summary(spark, sf):
    return P.producer_summary(_base(spark, sf))


_TOP5 = """,
tot AS (SELECT producerName, productName, coalesce(sum(qty), 0.0) AS units FROM pbase
        WHERE productName IS NOT NULL GROUP BY 1, 2),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY producerName
                                    ORDER BY units DESC, productName) AS rank FROM tot)
         WHERE rank <= 5)
"""


@register("top5_products", _PFILT + _TOP5 + """
SELECT producerName, productName, units, CAST(rank AS INTEGER) AS rank FROM top5
""")
def q_top5_products(spark, sf):
    return P.top_products_per_producer(_base(spark, sf), TOP_K) \
        .select("producerName", "productName", "units", F.col("rank").cast("int").alias("rank"))


@register("product_trends_top5", _PFILT + _TOP5 + """
SELECT p.producerName, p.periodStart, p.productName, coalesce(sum(p.qty), 0.0) AS total_qty
FROM pbase p JOIN top5 t ON p.producerName = t.producerName AND p.productName = t.productName
WHERE p.periodStart IS NOT NULL
GROUP BY 1, 2, 3
""")
def q_product_trends_top5(spark, sf):
    return P.product_trends_top(_base(spark, sf), TOP_K)


@register("last_n_periods", """
SELECT DISTINCT periodStart FROM order_items WHERE periodStart IS NOT NULL
ORDER BY periodStart DESC LIMIT 12
""")
def q_last_n_periods(spark, sf):
    return P.last_n_periods(landed_order_items(spark, sf), 12)


# -- availability -------------------------------------------------------------

_AFILT = r"""
WITH abase AS (
  SELECT priceLevel, periodStart,
         regexp_replace(regexp_replace(coalesce(producer, 'Unknown'), '^\s+', ''), '\s+$', '')
             AS producer,
         productName, quantityListed, quantitySold, quantityAvailable
  FROM availability WHERE priceLevel IN (SELECT id FROM price_levels WHERE "default"))
"""


@register("availability_trends", _AFILT + """
SELECT periodStart, producer, sum(quantityListed) AS quantityListed,
       sum(quantityAvailable) AS quantityAvailable, sum(quantitySold) AS quantitySold
FROM abase WHERE periodStart IS NOT NULL GROUP BY 1, 2
""")
def q_availability_trends(spark, sf):
    return P.availability_trends(_avail_default(spark, sf))


@register("availability_summary", _AFILT + """
SELECT producer, CAST(count(DISTINCT productName) AS BIGINT) AS num_products,
       sum(quantityListed) AS quantityListed, sum(quantityAvailable) AS quantityAvailable,
       sum(quantitySold) AS quantitySold
FROM abase GROUP BY 1
""")
def q_availability_summary(spark, sf):
    return P.availability_summary(_avail_default(spark, sf))


@register("availability_by_product", _AFILT + """
SELECT producer, productName, sum(quantityListed) AS quantityListed,
       sum(quantityAvailable) AS quantityAvailable, sum(quantitySold) AS quantitySold
FROM abase WHERE productName IS NOT NULL
GROUP BY 1, 2
""")
def q_availability_by_product(spark, sf):
    return P.availability_by_product(_avail_default(spark, sf))


@register("availability_count_by_level", """
SELECT p.id, p.name, p."default", CAST(count(a.priceLevel) AS BIGINT) AS rows
FROM price_levels p
LEFT JOIN availability a ON a.priceLevel = p.id
GROUP BY 1, 2, 3
""")
def q_availability_count_by_level(spark, sf):
    return P.availability_count_by_level(price_levels(spark, sf), landed_availability(spark, sf))


@register("price_level_labels", """
SELECT id, name || ' (id=' || CAST(id AS VARCHAR) || ')' AS label FROM price_levels
""")
def q_price_level_labels(spark, sf):
    return P.price_level_labels(price_levels(spark, sf))

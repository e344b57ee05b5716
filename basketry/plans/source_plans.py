"""Registered source / sink queries (S1-S10).

Each one lands data that Spark derives from the given tables in the shared
checkpoint folder and reads it back through the operator under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators.orders import aov_by_type_period, orders_at_order_level
from basketry.plans.registry import register
from basketry.schemas import ORDER_ITEMS
from basketry.session import scratch_path
from basketry.sources import files as S
from basketry.sources.adapters import (landed_availability, landed_customers, landed_order_items,
                                       landed_path, price_levels)
from basketry.sources.incremental import LandedTable, read_landed, refresh
from basketry.sources.json_variant import read_variant_lines, variant_flatten

_ITEM_COLS = ", ".join(f.name for f in ORDER_ITEMS.fields)


@register("csv_scan", f"SELECT {_ITEM_COLS} FROM order_items")
def q_csv_scan(spark, sf):
    path = scratch_path(spark, "csv-orders")
    S.csv_sink(landed_order_items(spark, sf), path)
    return S.csv_scan(spark, path, ORDER_ITEMS)


@register("csv_sink", """
SELECT periodStart, customerType,
       CAST(count(DISTINCT orderId) AS BIGINT) AS orders,
       CAST(sum(orderSubTotal) AS DOUBLE) / count(orderSubTotal) AS avg_order_subtotal,
       CAST(sum(orderTotal) AS DOUBLE) / count(orderTotal) AS avg_order_total,
       coalesce(CAST(sum(orderSubTotal) AS DOUBLE), 0.0) AS sum_order_subtotal,
       coalesce(CAST(sum(orderTotal) AS DOUBLE), 0.0) AS sum_order_total
FROM order_level GROUP BY periodStart, customerType
""")
def q_csv_sink(spark, sf):
    """Write the AOV aggregation as CSV and read it back with its own schema."""
    agg = aov_by_type_period(landed_order_items(spark, sf))
    path = scratch_path(spark, "csv-aov")
    S.csv_sink(agg, path)
    return S.csv_scan(spark, path, agg.schema)


def _nested_orders(spark, sf):
    """One nested JSON record per order: id, customer{name,type}, items[...].

    Orders without items have an empty list. An order's list is bounded by
    the format: a JSON record is read whole.
    """
    items = landed_order_items(spark, sf).where(F.col("orderId").isNotNull())
    entry = F.when(F.col("itemOrder").isNotNull(), F.struct(F.col("productName").alias("product"), F.col("qty")))
    doc = items.groupBy(F.col("orderId").alias("id")).agg(
        F.struct(F.max("customerName").alias("name"), F.max("customerType").alias("type")).alias("customer"),
        F.collect_list(entry).alias("items"))
    path = scratch_path(spark, "json-orders")
    doc.write.mode("overwrite").json(path)
    return S.read_json(spark, path, doc.schema)


@register("json_flatten", """
SELECT productName AS product, qty, orderId AS id, customerName AS "customer.name",
       customerType AS "customer.type"
FROM order_items WHERE orderId IS NOT NULL AND itemOrder IS NOT NULL
""")
def q_json_flatten(spark, sf):
    return S.json_flatten(_nested_orders(spark, sf), record_path="items",
                          meta=["id", ["customer", "name"], "customer.type"])


@register("json_flatten_events", """
SELECT event_id, ts, user_id, event_type, value,
       CAST(json_extract(props, '$.k') AS INTEGER) AS "props.k"
FROM events
""")
def q_json_flatten_events(spark, sf):
    from basketry.sources.tables import read_table
    ev = read_table(spark, sf, "events")
    parsed = ev.withColumn("props", F.from_json("props", "k int"))
    return S.json_flatten(parsed)


# The events as JSON lines whose "tags" are a list, one object, a number, null,
# missing or empty, whose "user" is a number, an object or text; some lines are no JSON.
# Plain SQL, so that both engines build the same text.
_MIXED_EVENT = """
CASE event_id % 7
WHEN 0 THEN concat('{"id":', event_id, ',"user":', user_id, ',"tags":[', props, ',{"k":"', user_id, '"},null]}')
WHEN 1 THEN concat('{"id":"e', event_id, '","user":{"id":', user_id, ',"kind":"', event_type, '"},"tags":', props, '}')
WHEN 2 THEN concat('{"id":', event_id, ',"user":"', event_type, '","tags":', user_id, '}')
WHEN 3 THEN concat('{"id":', event_id, ',"tags":[]}')
WHEN 4 THEN concat('{"id":', event_id, ',"user":null}')
WHEN 5 THEN concat('{"id":', event_id, ',"user":', user_id, ',"tags":[', user_id, ',[', event_id, '],{"k":', props, '}]}')
ELSE concat('{"id":', event_id, ',"user":') END
"""


@register("json_flatten_mixed", f"""
WITH j AS (SELECT CAST(line AS JSON) AS j FROM (SELECT {_MIXED_EVENT} AS line FROM events) WHERE json_valid(line)),
e AS (SELECT j, unnest(CASE json_type(j, '$.tags') WHEN 'ARRAY' THEN json_extract(j, '$.tags[*]')
                       WHEN 'NULL' THEN [] ELSE [json_extract(j, '$.tags')] END) AS e
      FROM j WHERE json_type(j, '$.tags') IS NOT NULL)
SELECT CASE WHEN json_type(e, '$.k') <> 'OBJECT' THEN e ->> '$.k' END AS k,
       TRY_CAST(CASE WHEN json_type(e, '$.k') = 'OBJECT' THEN e ->> '$.k.k' END AS BIGINT) AS "k.k",
       CASE WHEN json_type(e) NOT IN ('OBJECT', 'NULL') THEN e ->> '$' END AS "0",
       j ->> '$.id' AS id, j ->> '$.user' AS "user", j ->> '$.user.kind' AS "user.kind"
FROM e
""")
def q_json_flatten_mixed(spark, sf):
    from basketry.sources.tables import read_table
    path = scratch_path(spark, "json-mixed")
    read_table(spark, sf, "events").select(F.expr(_MIXED_EVENT).alias("value")).write.text(path)
    return variant_flatten(read_variant_lines(spark, path), record_path="tags",
                           meta=["id", "user", ["user", "kind"]])


@register("orders_source", f"""
SELECT {_ITEM_COLS} FROM order_items
WHERE periodStart >= DATE '1996-01-01' AND periodStart <= DATE '1997-12-31'
""")
def q_orders_source(spark, sf):
    landed_order_items(spark, sf)
    path = landed_path(spark, "order_items", sf)
    return S.orders_source(spark, path, "1996-01-01", "1997-12-31").select(*ORDER_ITEMS.names)


@register("orders_incremental", f"SELECT {_ITEM_COLS} FROM order_items")
def q_orders_incremental(spark, sf):
    """Order items that arrive in two lots, the second of which touches some of the periods."""
    base = scratch_path(spark, "incremental-orders")
    table = LandedTable(f"{base}/landing", f"{base}/table", f"{base}/manifest", ORDER_ITEMS, "periodStart", ("orderId",))
    items = landed_order_items(spark, sf)
    late = F.coalesce(F.col("periodStart") >= F.lit("2001-06-01").cast("date"), F.lit(True)) & \
        F.coalesce(F.col("orderId") % 4 == 0, F.lit(True))
    items.where(~late).write.parquet(f"{table.landing}/lot=1")
    refresh(spark, table)
    items.where(late).write.parquet(f"{table.landing}/lot=2")
    refresh(spark, table)
    return read_landed(spark, table)


@register("customers_source", """
SELECT * FROM customers WHERE lastOrder > TIMESTAMP '1996-01-01 00:00:00'
""")
def q_customers_source(spark, sf):
    landed_customers(spark, sf)
    path = landed_path(spark, "customers", sf)
    return S.customers_source(spark, path, "1996-01-01")


@register("price_levels_source", "SELECT * FROM price_levels")
def q_price_levels_source(spark, sf):
    path = S.land(spark, price_levels(spark, sf), "price_levels", (sf,))
    return S.price_levels_source(spark, path)


@register("availability_source", """
SELECT priceLevel, periodStart, producer, productName, quantityListed, quantitySold,
       quantityAvailable
FROM availability WHERE priceLevel IN (SELECT id FROM price_levels WHERE "default")
""")
def q_availability_source(spark, sf):
    landed_availability(spark, sf)
    path = landed_path(spark, "availability", sf)
    df = S.availability_source(spark, path, price_levels(spark, sf), 0)
    return df.select("priceLevel", "periodStart", "producer", "productName", "quantityListed",
                     "quantitySold", "quantityAvailable")


@register("preview", "SELECT * FROM order_level ORDER BY orderId LIMIT 20")
def q_preview(spark, sf):
    return S.preview(orders_at_order_level(landed_order_items(spark, sf)), 20, ["orderId"])


def _describe_sql() -> str:
    parts = []
    for f in ORDER_ITEMS.fields:
        c = f'"{f.name}"'
        kind = f.dataType.typeName()
        if kind in ("long", "double", "decimal", "integer"):
            x = f"CAST({c} AS DOUBLE)"
            parts.append(
                f"SELECT '{f.name}' AS \"column\", CAST(count({c}) AS BIGINT) AS count, "
                f"CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, "
                f"CAST(NULL AS BIGINT) AS freq, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, "
                f"min({x}) AS min, quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50, "
                f"quantile_cont({x}, 0.75) AS p75, max({x}) AS max FROM order_items")
        else:
            v = f"strftime({c}, '%Y-%m-%d')" if kind == "date" else c
            parts.append(
                f"SELECT '{f.name}' AS \"column\", CAST(coalesce(sum(n), 0) AS BIGINT) AS count, "
                f"CAST(count(*) AS BIGINT) AS \"unique\", arg_min(v, (-n, v)) AS top, "
                f"CAST(max(n) AS BIGINT) AS freq, CAST(NULL AS DOUBLE) AS mean, "
                f"CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS p25, "
                f"CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75, CAST(NULL AS DOUBLE) AS max "
                f"FROM (SELECT {v} AS v, count(*) AS n FROM order_items WHERE {c} IS NOT NULL GROUP BY 1)")
    return "\nUNION ALL\n".join(parts)


@register("describe_all", _describe_sql())
def q_describe_all(spark, sf):
    """Mean and deviation to six places: engines differ in the last bits of a double sum."""
    return S.describe_all(landed_order_items(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("mean", "std")})


_SQL_TYPES = {"long": "bigint", "integer": "int", "decimal": "decimal(18,2)"}


@register("describe_types", "\nUNION ALL\n".join(
    f"SELECT '{f.name}' AS \"column\", '{_SQL_TYPES.get(f.dataType.typeName(), f.dataType.typeName())}' AS type, "
    f"CAST(count(\"{f.name}\") AS BIGINT) AS non_null FROM order_items" for f in ORDER_ITEMS.fields))
def q_describe_types(spark, sf):
    return S.describe_types(landed_order_items(spark, sf))

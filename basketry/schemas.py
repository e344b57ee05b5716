"""Declared schemas of the logical tables and the schema guard."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

ORDER_ITEMS = T.StructType([
    T.StructField("orderId", T.LongType()),
    T.StructField("itemOrder", T.LongType()),
    T.StructField("periodStart", T.DateType()),
    T.StructField("customerType", T.StringType()),
    T.StructField("orderSubTotal", MONEY),
    T.StructField("orderTotal", MONEY),
    T.StructField("orderStatus", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("customerId", T.LongType()),
    T.StructField("customerName", T.StringType()),
    T.StructField("locationName", T.StringType()),
    T.StructField("qty", T.DoubleType()),
    T.StructField("productName", T.StringType()),
    T.StructField("producerName", T.StringType()),
])

CUSTOMERS = T.StructType([
    T.StructField("customerId", T.LongType()),
    T.StructField("fullName", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("custType", T.StringType()),
    T.StructField("locName", T.StringType()),
    T.StructField("plName", T.StringType()),
    T.StructField("totalOrders", T.LongType()),
    T.StructField("totalSales", T.DoubleType()),
    T.StructField("firstOrder", T.TimestampType()),
    T.StructField("lastOrder", T.TimestampType()),
    T.StructField("dateEntered", T.TimestampType()),
])

PRICE_LEVELS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("markup", T.DoubleType()),
    T.StructField("default", T.BooleanType()),
])

AVAILABILITY = T.StructType([
    T.StructField("priceLevel", T.IntegerType()),
    T.StructField("periodStart", T.DateType()),
    T.StructField("producer", T.StringType()),
    T.StructField("productName", T.StringType()),
    T.StructField("quantityListed", T.DoubleType()),
    T.StructField("quantitySold", T.DoubleType()),
    T.StructField("quantityAvailable", T.DoubleType()),
])


class MissingColumnsError(ValueError):
    def __init__(self, missing: list[str]):
        self.missing = missing
        super().__init__("missing required columns: " + ", ".join(missing))


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Raise ``MissingColumnsError`` naming the missing columns (sorted)."""
    missing = missing_columns(df, required)
    if missing:
        raise MissingColumnsError(missing)
    return df

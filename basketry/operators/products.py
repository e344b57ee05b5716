"""Product, producer and availability operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Column, Window
from pyspark.sql import functions as F

from basketry.functions.cleaning import strip_ws

UNKNOWN = "Unknown"
QTY_COLUMNS = ["quantityListed", "quantityAvailable", "quantitySold"]


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of ``column`` (a selector's options)."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def first_values(df: DataFrame, column: str, k: int, last: bool = False) -> DataFrame:
    """The ``k`` smallest (or largest) distinct non-null values of ``column``.

    The result has at most ``k`` rows (a distributed top-n, not a full sort).
    """
    d = df.select(column).where(F.col(column).isNotNull()).distinct()
    return d.orderBy(F.desc(column) if last else F.asc(column)).limit(k)


def product_base(items: DataFrame, producer_col: str = "producerName") -> DataFrame:
    """Item rows with a date period and the producer null -> "Unknown", stripped."""
    return items.withColumns({
        "periodStart": F.col("periodStart").try_cast("date"),
        producer_col: strip_ws(F.coalesce(F.col(producer_col).cast("string"), F.lit(UNKNOWN))),
    })


def default_product_filter(base: DataFrame, producer_col: str = "producerName",
                           n_producers: int = 5, n_periods: int = 12) -> DataFrame:
    """Rows of the default selection: first producers alphabetically, last periods.

    Each list is a distributed top-n of at most ``n`` rows and is applied as a
    semi join, so no value passes the driver and the plan stays lazy.
    """
    return (base.join(first_values(base, "periodStart", n_periods, last=True), "periodStart", "left_semi")
            .join(first_values(base, producer_col, n_producers), producer_col, "left_semi")
            .select(*base.columns))


def last_n_periods(df: DataFrame, n: int = 12, column: str = "periodStart") -> DataFrame:
    return first_values(df, column, n, last=True).orderBy(column)


def producer_trends(rows: DataFrame) -> DataFrame:
    """Units, distinct orders and distinct products per (period, producer).

    The rows are shuffled once, by period and producer: there are about as many
    of those pairs as rows, so partial sums would not shrink them, and both
    distinct counts are then taken where the rows are.
    """
    keys = ["periodStart", "producerName"]
    narrow = (rows.dropna(subset=keys).select(*keys, "qty", "orderId", "productName").repartition(*keys))
    none = {c: F.lit(None).cast(narrow.schema[c].dataType).alias(c) for c in ("qty", "orderId", "productName")}
    pairs = narrow.select(*keys, F.inline(F.array(F.struct(F.col("qty"), F.col("orderId"), none["productName"]),
                                                  F.struct(none["qty"], none["orderId"], F.col("productName")))))
    return (pairs.groupBy(*keys, "orderId", "productName").agg(F.sum("qty").alias("_qty"))
            .groupBy(*keys).agg(
                F.coalesce(F.sum("_qty"), F.lit(0.0)).alias("total_qty"),
                F.count("orderId").cast("long").alias("num_orders"),
                F.count("productName").cast("long").alias("num_products")))


def producer_summary(rows: DataFrame) -> DataFrame:
    """Per producer: distinct products, units, mean units per row, distinct orders."""
    return (rows.where(F.col("producerName").isNotNull())
            .groupBy("producerName").agg(
                F.countDistinct("productName").cast("long").alias("products"),
                F.coalesce(F.sum("qty"), F.lit(0.0)).alias("total_units"),
                F.avg("qty").alias("avg_units_per_order"),
                F.countDistinct("orderId").cast("long").alias("num_orders"))
            .orderBy(F.desc("total_units"), "producerName"))


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt_col: str, buckets: int = 64) -> DataFrame:
    """Exact top ``k`` rows per group without sorting a whole group in one task.

    Rows are first ranked inside (group, hash(salt_col) % buckets) slices and
    only each slice's top ``k`` survive; the final ranking per group then sees
    at most ``k * buckets`` rows, however large the group is. The global
    top ``k`` of a group is always among the slice winners, so nothing is lost.
    """
    salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(buckets))
    sliced = df.withColumn("_slice", salt)
    w1 = Window.partitionBy(*group, "_slice").orderBy(*order)
    pre = sliced.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (pre.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
            .drop("_slice", "_r"))


def top_products_per_producer(rows: DataFrame, k: int = 5) -> DataFrame:
    """Each producer's top ``k`` products by units (product name breaks ties)."""
    totals = (rows.where(F.col("producerName").isNotNull() & F.col("productName").isNotNull())
              .groupBy("producerName", "productName")
              .agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("units")))
    return top_k_per_group(totals, ["producerName"], [F.desc("units"), F.asc("productName")],
                           k, "productName")


def product_trends_top(rows: DataFrame, k: int = 5) -> DataFrame:
    """Units per (producer, period, product), limited to each producer's top products."""
    top = top_products_per_producer(rows, k).select("producerName", "productName")
    return (rows.dropna(subset=["periodStart", "producerName", "productName"])
            .join(top, ["producerName", "productName"], "left_semi")
            .groupBy("producerName", "periodStart", "productName")
            .agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("total_qty")))


# -- availability -------------------------------------------------------------

def _qty_sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0)).alias(c)


def _qty_cols(df: DataFrame) -> list[str]:
    return [c for c in QTY_COLUMNS if c in df.columns]


def availability_producer_col(df: DataFrame) -> str:
    if "producer" in df.columns:
        return "producer"
    if "producerName" in df.columns:
        return "producerName"
    raise ValueError(f"unexpected availability columns: {df.columns}")


def availability_trends(avail: DataFrame) -> DataFrame:
    """Sum of each quantity column per (period, producer)."""
    p = availability_producer_col(avail)
    return (avail.dropna(subset=["periodStart", p]).groupBy("periodStart", p)
            .agg(*[_qty_sum(c) for c in _qty_cols(avail)]))


def availability_summary(avail: DataFrame) -> DataFrame:
    p = availability_producer_col(avail)
    qty = _qty_cols(avail)
    out = (avail.where(F.col(p).isNotNull()).groupBy(p)
           .agg(F.countDistinct("productName").cast("long").alias("num_products"),
                *[_qty_sum(c) for c in qty]))
    return out.orderBy(*([F.desc("quantitySold")] if "quantitySold" in qty else []), F.desc(p))


def availability_by_product(avail: DataFrame, producer: str | None = None) -> DataFrame:
    """Quantity sums per (producer, product), or of one producer only, first quantity descending."""
    p = availability_producer_col(avail)
    qty = _qty_cols(avail)
    rows = avail.where(F.col(p).isNotNull() & F.col("productName").isNotNull())
    if producer is not None:
        rows = rows.where(F.col(p) == F.lit(producer))
    out = rows.groupBy(p, "productName").agg(*[_qty_sum(c) for c in qty])
    return out.orderBy(p, F.desc(qty[0]), "productName") if qty else out


def availability_count_by_level(levels: DataFrame, avail: DataFrame) -> DataFrame:
    """Rows of availability for each price level."""
    counts = avail.groupBy("priceLevel").agg(F.count(F.lit(1)).alias("rows"))
    return (levels.join(counts, levels["id"] == counts["priceLevel"], "left")
            .select("id", "name", "default",
                    F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("rows")))


def price_level_labels(levels: DataFrame) -> DataFrame:
    """``name (id=n)`` label for each price level."""
    return levels.select("id", F.concat(F.col("name").cast("string"), F.lit(" (id="),
                                        F.col("id").cast("string"), F.lit(")")).alias("label"))

"""Customer operators: recency, RFM segments, customer lifetime value.

Thresholds (percentiles) are global statistics: they are computed first with
the distributed exact quantile (a few scalars reach the driver), then applied
as literals in one ``when`` chain, so the per-customer work is a single
narrow projection with no join at all.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from basketry.functions.cleaning import (as_of_literal, floor_days_between, strip_ws,
                                         to_number, to_timestamp_lenient)
from basketry.functions.quantiles import exact_quantiles, exact_quantiles_multi
from basketry.operators.joins import split_join

AS_OF = "1996-06-30 00:00:00"

# Segment names in display order, and the suggested action
# text for each segment.
SEGMENT_ORDER = ["Champions", "Loyal", "At-Risk", "Regular", "New", "Lost",
                 "Occasional", "Never Ordered"]
SEGMENT_ACTIONS = {
    "Champions":     "🎁 Reward: loyalty programme, early product access, referral asks",
    "Loyal":         "⬆️  Upsell: premium bundles, subscription upgrade offer",
    "At-Risk":       "🚨 Win-back: personal call or email, limited-time discount",
    "Regular":       "📈 Nurture: increase frequency, recurring-order nudge",
    "New":           "👋 Onboard: welcome series, highlight popular products",
    "Lost":          "💌 Re-engage: 'We miss you' promo, satisfaction survey",
    "Occasional":    "🛒 Reactivate: seasonal promotions, low-barrier offer",
    "Never Ordered": "📣 Activate: first-order incentive, demo / intro call",
}
INSUFFICIENT = "Insufficient Data"
MIN_ACTIVE_FOR_SEGMENTS = 5
MIN_ACTIVE_FOR_TIERS = 3
DAYS_PER_MONTH_CLV = 30.44
CLV_MONTH_CHOICES = (3, 6, 12, 24, 36)

DISPLAY_COLUMNS = ["fullName", "email", "custType", "locName", "plName", "totalOrders",
                   "totalSales", "days_since_last_order", "firstOrder", "lastOrder"]


def _count_col(df: DataFrame, c: str) -> Column:
    """pandas to_numeric + fillna(0); integral inputs stay integral."""
    if c not in df.columns:
        return F.lit(0).cast("long")
    if dict(df.dtypes)[c] in ("bigint", "int", "smallint", "tinyint"):
        return F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return to_number(c)


def customer_recency(customers: DataFrame, as_of: str | _dt.datetime = AS_OF) -> DataFrame:
    """Parse dates, coerce totals (missing -> 0), add whole-day recency and age."""
    df = customers
    for c in ("lastOrder", "firstOrder", "dateEntered"):
        if c in df.columns:
            df = df.withColumn(c, to_timestamp_lenient(c))
    now = as_of_literal(as_of)
    df = df.withColumns({
        "totalOrders": _count_col(df, "totalOrders"),
        "totalSales": to_number("totalSales") if "totalSales" in df.columns else F.lit(0.0),
    })
    return df.withColumns({
        "days_since_last_order": floor_days_between(now, "lastOrder")
        if "lastOrder" in df.columns else F.lit(None).cast("long"),
        "customer_age_days": floor_days_between(now, "firstOrder")
        if "firstOrder" in df.columns else F.lit(None).cast("long"),
    })


@dataclass
class RfmThresholds:
    n_active: int
    r_p33: float | None
    f_p66: float | None
    m_p66: float | None


def _active(rec: DataFrame) -> DataFrame:
    return rec.where((F.col("totalOrders") > 0) & F.col("days_since_last_order").isNotNull())


def rfm_thresholds(rec: DataFrame) -> RfmThresholds:
    """33rd percentile of recency, 66th of orders and of sales over active customers."""
    q, counts = exact_quantiles_multi(_active(rec), {"days_since_last_order": [0.33],
                                                     "totalOrders": [0.66],
                                                     "totalSales": [0.66]})
    n = counts["days_since_last_order"]   # every active row has a recency
    if n < MIN_ACTIVE_FOR_SEGMENTS:
        return RfmThresholds(n, None, None, None)
    return RfmThresholds(n, q["days_since_last_order"][0], q["totalOrders"][0], q["totalSales"][0])


def segment_expr(t: RfmThresholds) -> Column:
    """The eight segments, first match wins."""
    if t.n_active < MIN_ACTIVE_FOR_SEGMENTS:
        return F.lit(INSUFFICIENT)
    r, f, m = F.col("days_since_last_order"), F.col("totalOrders"), F.col("totalSales")
    age = F.col("customer_age_days")
    rp, fp, mp = F.lit(t.r_p33), F.lit(t.f_p66), F.lit(t.m_p66)
    return (F.when(F.col("lastOrder").isNull() | r.isNull(), "Never Ordered")
            .when(age.isNotNull() & (age <= 90) & (f <= 2), "New")
            .when(r > 270, "Lost")
            .when((r <= rp) & (f >= fp) & (m >= mp), "Champions")
            .when((f >= fp) & (m >= mp) & (r <= 180), "Loyal")
            .when(((m >= mp) | (f >= fp)) & (r > 90), "At-Risk")
            .when((r <= 90) & (f >= 1), "Regular")
            .otherwise("Occasional"))


def segment_customers(customers: DataFrame, as_of: str | _dt.datetime = AS_OF) -> DataFrame:
    """Customers with recency, age and ``segment``."""
    rec = customer_recency(customers, as_of)
    if "lastOrder" not in rec.columns:
        rec = rec.withColumn("lastOrder", F.lit(None).cast("timestamp"))
    return rec.withColumn("segment", segment_expr(rfm_thresholds(rec)))


def action_for(segment: Column) -> Column:
    """Suggested action text; unknown segments give an empty string."""
    m = F.create_map(*[F.lit(x) for kv in SEGMENT_ACTIONS.items() for x in kv])
    return F.coalesce(m[segment], F.lit(""))


def segment_kpis(seg: DataFrame) -> DataFrame:
    s = F.col("segment")
    return seg.agg(F.count(F.lit(1)).cast("long").alias("total_customers"),
                   F.count_if(s.isin("Champions", "Loyal")).cast("long").alias("champions_loyal"),
                   F.count_if(s == "At-Risk").cast("long").alias("at_risk"),
                   F.count_if(s == "Lost").cast("long").alias("lost"),
                   F.count_if(s == "New").cast("long").alias("new")) \
        .withColumn("champions_loyal_pct",
                    F.when(F.col("total_customers") == 0, F.lit(None).cast("double"))
                    .otherwise(F.col("champions_loyal") * 100.0 / F.col("total_customers")))


def segment_profile(seg: DataFrame) -> DataFrame:
    """Per segment (null -> "Unknown"): size, mean sales / orders / recency, action."""
    prof = seg.groupBy("segment").agg(
        F.count("totalOrders").cast("long").alias("customers"),
        F.avg(F.col("totalSales").cast("double")).alias("avg_total_sales"),
        F.avg(F.col("totalOrders").cast("double")).alias("avg_total_orders"),
        F.avg(F.col("days_since_last_order").cast("double")).alias("avg_days_since_last"))
    seg_name = F.coalesce(F.col("segment"), F.lit("Unknown"))
    return prof.select(seg_name.alias("segment"), "customers", "avg_total_sales",
                       "avg_total_orders", "avg_days_since_last",
                       action_for(seg_name).alias("suggested_action")) \
        .orderBy(F.desc("customers"), "segment")


def segment_drilldown(seg: DataFrame, segment: str) -> DataFrame:
    """Customers of one segment, display columns present, dates as text,
    largest total sales first."""
    cols = [c for c in DISPLAY_COLUMNS if c in seg.columns]
    out = seg.where(F.col("segment") == segment)
    sel = [F.col("customerId")] if "customerId" in seg.columns else []
    for c in cols:
        sel.append(F.date_format(c, "yyyy-MM-dd").alias(c) if c in ("firstOrder", "lastOrder")
                   else F.col(c))
    out = out.select(*sel)
    return out.orderBy(F.desc("totalSales"), *_tie(out)) if "totalSales" in cols else out


def _tie(df: DataFrame) -> list[str]:
    """Rows of equal value are listed by customer."""
    return [c for c in ("customerId", "email") if c in df.columns][:1]


CANDIDATE_COLUMNS = ["customerId", "fullName", "email", "custType", "totalOrders",
                     "totalSales", "days_since_last_order"]


def _candidates(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in CANDIDATE_COLUMNS if c in df.columns]) \
        .orderBy(F.desc("totalSales"), *_tie(df))


def lookalike_regular_to_loyal(seg: DataFrame) -> DataFrame:
    """Regular customers whose sales reach the 25th percentile of Loyal + Champions."""
    (q,) = exact_quantiles(seg.where(F.col("segment").isin("Loyal", "Champions")),
                           "totalSales", [0.25])
    if q is None:   # nothing to compare with: NaN comparisons are all false
        return _candidates(seg.where(F.lit(False)))
    return _candidates(seg.where((F.col("segment") == "Regular") & (F.col("totalSales") >= q)))


def lookalike_winback_at_risk(seg: DataFrame) -> DataFrame:
    """At-Risk customers with sales at or above the At-Risk median (0 if none)."""
    at_risk = seg.where(F.col("segment") == "At-Risk")
    (med,) = exact_quantiles(at_risk, "totalSales", [0.5])
    return _candidates(at_risk.where(F.col("totalSales") >= F.lit(med if med is not None else 0.0)))


def lookalike_occasional_recent(seg: DataFrame) -> DataFrame:
    """Occasional customers whose last order is under 90 days ago."""
    return _candidates(seg.where((F.col("segment") == "Occasional")
                                 & (F.coalesce(F.col("days_since_last_order"), F.lit(999)) < 90)))


# -- orders of a segment ------------------------------------------------------

def normalized_email(c: str | Column) -> Column:
    return F.lower(strip_ws(c))


def segment_orders_semi_join(items: DataFrame, seg: DataFrame, segment: str) -> DataFrame:
    """Order item rows whose e-mail (stripped, lower case) belongs to the segment.

    A left semi join on the normalised e-mail with the distinct key set of the
    segment; e-mails with many orders are split off (``joins.split_join``).
    """
    def keyed(df: DataFrame) -> DataFrame:
        # a null e-mail matches only an empty one: null rows, which would be one
        # hot key, are left out unless the segment has such a customer
        return df.withColumn("_email_key", normalized_email("email"))

    keys = (keyed(seg.where((F.col("segment") == segment) & F.col("email").isNotNull()))
            .select("_email_key").distinct())
    known = split_join(keyed(items.where(F.col("email").isNotNull())), keys, "_email_key", "left_semi").drop("_email_key")
    nameless = items.where(F.col("email").isNull())
    has_empty = keys.where(F.col("_email_key") == "").agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(nameless.withColumn("_n", has_empty.scalar()).where("_n > 0").drop("_n"))


def segment_order_insights(seg_orders: DataFrame) -> DataFrame:
    """Distinct orders, mean order total, total revenue of the segment's orders."""
    from basketry.operators.orders import orders_at_order_level
    ol = orders_at_order_level(seg_orders)
    return ol.agg(F.countDistinct("orderId").cast("long").alias("orders"),
                  (F.sum("orderTotal").cast("double") / F.count("orderTotal")).alias("avg_order_value"),
                  F.coalesce(F.sum("orderTotal").cast("double"), F.lit(0.0)).alias("total_revenue"))


def segment_monthly_revenue(seg_orders: DataFrame, months: int = 24) -> DataFrame:
    """Revenue per calendar month (``yyyy-MM``) of the last ``months`` months."""
    from basketry.operators.orders import orders_at_order_level
    ol = orders_at_order_level(seg_orders).where(F.col("periodStart").isNotNull())
    by_month = ol.groupBy(F.date_format("periodStart", "yyyy-MM").alias("month")).agg(
        F.coalesce(F.sum("orderTotal").cast("double"), F.lit(0.0)).alias("revenue"))
    return by_month.orderBy(F.desc("month")).limit(months).orderBy("month")


def top_products_segment(seg_orders: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` products by units within the segment's orders (name breaks ties)."""
    return (seg_orders.where(F.col("productName").isNotNull())
            .groupBy("productName").agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("units"))
            .orderBy(F.desc("units"), "productName").limit(k))


# -- customer lifetime value -------------------------------------------------

def calculate_clv(seg: DataFrame, projection_months: int = 12) -> DataFrame:
    """Historical, average order value, orders per month and projected CLV."""
    hist = F.greatest(to_number("totalSales") if "totalSales" in seg.columns else F.lit(0.0),
                      F.lit(0.0))
    orders = to_number("totalOrders") if "totalOrders" in seg.columns else F.lit(0.0)
    age_m = (to_number("customer_age_days") if "customer_age_days" in seg.columns
             else F.lit(0.0)) / F.lit(DAYS_PER_MONTH_CLV)
    df = seg.withColumns({"historical_clv": hist, "_orders": orders, "_age_m": age_m})
    df = df.withColumns({
        "avg_order_value": F.when(F.col("_orders") > 0, F.col("historical_clv") / F.col("_orders"))
                            .otherwise(F.lit(0.0)),
        "orders_per_month": F.when(F.col("_age_m") > 0.5, F.col("_orders") / F.col("_age_m"))
                             .otherwise(F.lit(0.0)),
    })
    df = df.withColumn("projected_clv", F.greatest(
        F.col("avg_order_value") * F.col("orders_per_month") * F.lit(float(projection_months)),
        F.lit(0.0)))
    return df.drop("_age_m")


def clv_tiers(clv: DataFrame) -> DataFrame:
    """High / Medium / Low by the 66th / 33rd percentile of active customers."""
    q, counts = exact_quantiles_multi(clv.where(F.col("_orders") > 0),
                                      {"projected_clv": [0.33, 0.66]})
    if counts["projected_clv"] >= MIN_ACTIVE_FOR_TIERS:
        p33, p66 = q["projected_clv"]
    else:
        p33, p66 = 0.0, 0.0
    tier = (F.when(~(F.col("_orders") > 0), "No Orders")
            .when(F.col("projected_clv") >= F.lit(p66), "High")
            .when(F.col("projected_clv") >= F.lit(p33), "Medium")
            .otherwise("Low"))
    return clv.withColumn("clv_tier", tier).drop("_orders")


def customer_clv(seg: DataFrame, projection_months: int = 12) -> DataFrame:
    if projection_months not in CLV_MONTH_CHOICES:
        raise ValueError(f"projection_months must be one of {CLV_MONTH_CHOICES}")
    return clv_tiers(calculate_clv(seg, projection_months))


def _active_clv(clv: DataFrame) -> DataFrame:
    return clv.where(F.col("totalOrders") > 0)


def clv_kpis(clv: DataFrame) -> DataFrame:
    """Portfolio sum, mean and median projected CLV, high-tier count, historical sum."""
    active = _active_clv(clv)
    (med,) = exact_quantiles(active, "projected_clv", [0.5])
    return active.agg(
        F.coalesce(F.sum("projected_clv"), F.lit(0.0)).alias("portfolio_projected_clv"),
        F.avg("projected_clv").alias("avg_clv"),
        F.count_if(F.col("clv_tier") == "High").cast("long").alias("high_tier_customers"),
        F.coalesce(F.sum("historical_clv"), F.lit(0.0)).alias("total_historical_clv"),
    ).withColumn("median_clv", F.lit(med).cast("double"))


def clv_by_segment(clv: DataFrame) -> DataFrame:
    return (_active_clv(clv).groupBy("segment").agg(
        F.avg("projected_clv").alias("avg_clv"),
        F.sum("projected_clv").alias("total_clv"),
        F.count("projected_clv").cast("long").alias("customers"))
        .orderBy(F.desc("avg_clv"), "segment"))


def clv_segment_summary(clv: DataFrame) -> DataFrame:
    return (_active_clv(clv).groupBy("segment").agg(
        F.count("projected_clv").cast("long").alias("customers"),
        F.avg("historical_clv").alias("avg_historical_clv"),
        F.avg("projected_clv").alias("avg_projected_clv"),
        F.sum("projected_clv").alias("total_projected_clv"),
        F.avg("avg_order_value").alias("avg_aov"),
        F.avg("orders_per_month").alias("avg_orders_per_month"))
        .orderBy(F.desc("total_projected_clv"), "segment"))


def clv_histogram(clv: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width histogram of projected CLV of active customers, per tier.

    The range is one global min / max aggregate (two scalars); each row then
    gets its bin by arithmetic and one grouped count finishes the job.
    """
    active = _active_clv(clv)
    lo, hi = active.agg(F.min("projected_clv"), F.max("projected_clv")).first()
    if lo is None:
        return active.select(F.col("clv_tier"), F.lit(1).alias("bin"),
                             F.lit(0.0).alias("bin_start"), F.lit(0.0).alias("bin_end"),
                             F.lit(0).cast("long").alias("customers")).where(F.lit(False))
    width = (hi - lo) / bins
    x = F.col("projected_clv")
    b = (F.lit(1) if hi == lo else
         F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)).cast("int") + 1,
                 F.lit(bins)))
    return (active.groupBy("clv_tier", b.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("customers"))
            .select("clv_tier", "bin",
                    (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_end"),
                    "customers"))


def aov_vs_frequency(clv: DataFrame) -> DataFrame:
    return _active_clv(clv).select(
        *[c for c in ("customerId", "fullName") if c in clv.columns],
        "orders_per_month", "avg_order_value", "historical_clv", "projected_clv",
        "clv_tier", "segment", "totalOrders", "totalSales")


CLV_COLUMNS = ["fullName", "email", "custType", "segment", "clv_tier", "historical_clv",
               "projected_clv", "avg_order_value", "orders_per_month", "totalOrders",
               "days_since_last_order"]


def clv_table(clv: DataFrame) -> DataFrame:
    cols = [c for c in ["customerId"] + CLV_COLUMNS if c in clv.columns]
    return clv.select(*cols).orderBy(F.desc("projected_clv"), *_tie(clv))

"""Calendar operators: date windows, period dimension, period comparisons."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from basketry.functions.cleaning import as_of_literal, pct_change

COMPARISON_METRICS = ["revenue", "total_orders", "aov", "pct_orders_over",
                      "new_customers", "recurring_pct"]
MONEY_METRICS = ("revenue",)   # summed as exact decimals, so the result is order-free
RATIO_METRICS = ("aov", "pct_orders_over", "recurring_pct")   # summed in the order of period and type


def rolling_date_window(df: DataFrame, column: str, last_days: int | None = None,
                        start: str | None = None, end: str | None = None,
                        as_of: str | _dt.datetime = "1996-06-30 00:00:00") -> DataFrame:
    """Explicit ``start``/``end`` win; else ``as_of - last_days`` .. ``as_of``;
    neither gives no filter. Bounds are inclusive; a simple range predicate
    that Parquet row-group statistics can use."""
    ts = F.col(column).cast("timestamp")
    if start or end:
        cond = F.lit(True)
        if start:
            cond = cond & (ts >= F.lit(start).cast("timestamp"))
        if end:
            cond = cond & (ts <= F.lit(end).cast("timestamp"))
        return df.where(cond)
    if last_days is None:
        return df
    hi = as_of_literal(as_of)
    lo = hi - F.make_interval(days=F.lit(int(last_days)))
    return df.where((ts >= lo) & (ts <= hi))


def period_dimension(base: DataFrame, column: str = "periodStart") -> DataFrame:
    """Distinct periods with Year, MonthStart, ISO year / week and ``YYYY-Www``."""
    p = F.col(column)
    week = F.weekofyear("periodStart").cast("int")
    iso_year = F.extract(F.lit("YEAROFWEEK"), F.col("periodStart")).cast("int")
    return (base.select(p.alias("periodStart")).where(p.isNotNull()).distinct()
            .select("periodStart",
                    F.year("periodStart").cast("int").alias("year"),
                    F.date_trunc("month", "periodStart").cast("date").alias("month_start"),
                    iso_year.alias("iso_year"),
                    week.alias("iso_week"),
                    F.concat(iso_year.cast("string"), F.lit("-W"),
                             F.lpad(week.cast("string"), 2, "0")).alias("week_key")))


def period_hierarchy_filter(dim: DataFrame, years: list[int] | None = None,
                            months: list[str] | None = None,
                            weeks: list[str] | None = None) -> DataFrame:
    """Periods that satisfy the year, month and week selections (None = all)."""
    out = dim
    if years is not None:
        out = out.where(F.col("year").isin(list(years)))
    if months is not None:
        out = out.where(F.col("month_start").isin([F.lit(m).cast("date") for m in months]))
    if weeks is not None:
        out = out.where(F.col("week_key").isin(list(weeks)))
    return out.select("periodStart")


# -- comparisons -------------------------------------------------------------

def _label(freq: str, d: Column) -> Column:
    if freq == "W":      # weeks end on Sunday
        return F.date_add(F.date_trunc("week", d).cast("date"), 6)
    if freq == "ME":     # month end
        return F.last_day(d)
    if freq == "YE":     # year end
        return F.make_date(F.year(d), F.lit(12), F.lit(31))
    raise ValueError(f"unknown frequency {freq}")


def _previous(freq: str, label: Column) -> Column:
    if freq == "W":
        return F.date_sub(label, 7)
    if freq == "ME":
        return F.last_day(F.add_months(label, -1))
    return F.make_date(F.year(label) - 1, F.lit(12), F.lit(31))


def _spine(freq: str, lo: Column, hi: Column) -> Column:
    if freq == "W":
        return F.sequence(lo, hi, F.expr("INTERVAL 7 DAYS"))
    if freq == "ME":
        return F.transform(F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"),
                                      F.expr("INTERVAL 1 MONTH")), lambda m: F.last_day(m))
    return F.transform(F.sequence(F.year(lo), F.year(hi)),
                       lambda y: F.make_date(y, F.lit(12), F.lit(31)))


def _sum_metric(c: str) -> Column:
    """Sums that do not depend on row order: money as decimal(38,2), counts as integers,
    ratios one by one in the order of the bin's sorted rows."""
    if c in MONEY_METRICS:
        return F.sum(F.col(c).cast("decimal(38,2)")).cast("double")
    if c in RATIO_METRICS:
        rows = F.sort_array(F.collect_list("_row"))          # one row a period and type of the bin
        return F.aggregate(rows, F.lit(0.0), lambda s, r: s + F.coalesce(r[c], F.lit(0.0)))
    return F.sum(c)


def period_comparison(metrics: DataFrame, freq: str,
                      metric_cols: list[str] = COMPARISON_METRICS,
                      recompute_ratios: bool = False) -> DataFrame:
    """Sum metrics over types per period, re-bin to week / month / year ends,
    fill empty bins with 0 and add the percent change to the previous bin.

    Like the pandas resample, ratio metrics are summed as well; with
    ``recompute_ratios`` the AOV is recomputed as revenue / orders per bin.
    The metrics are read once: the bins are folded into one map by label, and
    the calendar between the first and last of them looks up each label and the
    one before. What is brought together for that is a row a calendar bin (5,200
    weeks a century), so there is neither a join nor a window.
    """
    order = [c for c in ("period_start", "customer_type") if c in metrics.columns]
    ratios = [c for c in metric_cols if c in RATIO_METRICS]
    rows = metrics.withColumn("_label", _label(freq, F.col("period_start"))).where(F.col("_label").isNotNull())
    rows = rows.withColumn("_row", F.struct(*order, *ratios))
    binned = rows.groupBy("_label").agg(*[_sum_metric(c).alias(c) for c in metric_cols])
    if recompute_ratios and {"revenue", "total_orders", "aov"} <= set(metric_cols):
        binned = binned.withColumn(
            "aov", F.when(F.col("total_orders") == 0, F.lit(0.0))
            .otherwise(F.col("revenue") / F.col("total_orders")))
    types = {f.name: f.dataType for f in binned.schema.fields}
    bins = F.map_from_entries(F.collect_list(F.struct("_label", F.struct(*metric_cols))))
    calendar = binned.agg(bins.alias("bins"), F.min("_label").alias("lo"), F.max("_label").alias("hi"))
    labels = F.transform(_spine(freq, F.col("lo"), F.col("hi")), lambda d: F.struct(
        d.alias("period_label"), (d > F.col("lo")).alias("_has_previous"), F.try_element_at("bins", d).alias("_now"),
        F.try_element_at("bins", _previous(freq, d)).alias("_before")))
    zero = {c: F.lit(0).cast(types[c]) for c in metric_cols}
    filled = calendar.where(F.col("lo").isNotNull()).select(F.inline(labels)).select(
        "period_label", *[F.coalesce(F.col(f"_now.{c}"), zero[c]).alias(c) for c in metric_cols],
        *[F.when(F.col("_has_previous"), F.coalesce(F.col(f"_before.{c}"), zero[c])).cast("double").alias(f"_prev_{c}")
          for c in metric_cols])
    return filled.select(
        "period_label", *metric_cols,
        *[pct_change(F.col(c).cast("double"), F.col(f"_prev_{c}")).alias(f"{c}_pct")
          for c in metric_cols]).orderBy("period_label")

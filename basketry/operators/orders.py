"""Order-level operators: collapse of item rows, order value, period metrics.

Item rows carry order-level money on only one row per order. Everything here
is a declarative DataFrame plan; groupings use map-side partial aggregation,
so one very large order, customer or period cannot fill one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from basketry.functions.quantiles import grouped_medians
from basketry.functions.cleaning import safe_ratio, strip_ws, to_timestamp_lenient
from basketry.schemas import require_columns

ORDER_FIELDS = ["periodStart", "customerType", "orderSubTotal", "orderTotal", "orderStatus"]
CUSTOMER_FIELDS = ["email", "customerId", "customerName", "locationName"]


def status_filter(df: DataFrame, status: str | None) -> DataFrame:
    """Keep one ``orderStatus``; ``None``/``""``/``"All"`` keeps everything."""
    if not status or status == "All":
        return df
    return df.where(F.col("orderStatus") == F.lit(status))


def _money_sum(c: str) -> Column:
    """pandas ``sum``: nulls skipped, all-null gives 0; exact decimal, then double."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def _money_mean(c: str) -> Column:
    return (F.sum(c).cast("double") / F.count(c)).cast("double")


def _fixed_avg(c: str) -> Column:
    """Mean of a double column summed in fixed point (9 decimals), so the
    result does not depend on the order in which partitions are combined."""
    return F.sum(F.col(c).cast("decimal(38,9)")).cast("double") / F.count(c)


def summarize_orders(df: DataFrame) -> DataFrame:
    """One row: row count, total revenue, total items, distinct customers.

    A missing column counts as 0, like the pandas ``df.get`` default.
    """
    cols = set(df.columns)
    aggs = [F.count(F.lit(1)).cast("long").alias("num_orders"),
            _money_sum("orderTotal").alias("total_revenue") if "orderTotal" in cols
            else F.lit(0.0).alias("total_revenue"),
            F.coalesce(F.sum(F.col("qty").cast("double")), F.lit(0.0)).alias("total_items")
            if "qty" in cols else F.lit(0.0).alias("total_items"),
            F.countDistinct("customerId").cast("long").alias("unique_customers")
            if "customerId" in cols else F.lit(0).cast("long").alias("unique_customers")]
    return df.agg(*aggs)


_AGG_FUNCS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.countDistinct,
    "first": lambda c: _first_non_null(c, _ROW),
    "std": F.stddev_samp,
}


def aggregate_orders(df: DataFrame, group_by: Iterable[str],
                     metrics: dict[str, str | list[str]] | None = None) -> DataFrame:
    """Generic group-by; ``{column: fn}`` or ``{column: [fn, ...]}``.

    A single function keeps the column name; several give ``column_fn``.
    Null group keys are dropped, as pandas ``groupby`` does by default.
    Money columns (decimal) are summed exactly and returned as double. Medians
    are exact and found by ranks, so that no group's values are held in one place.
    """
    keys = list(group_by)
    metrics = metrics or {"orderTotal": "sum", "qty": "sum"}
    require_columns(df, keys + list(metrics))
    df = with_row_order(df)
    df = df.dropna(subset=keys)
    aggs, names, medians = [], [], {}
    for c, fns in metrics.items():
        many = isinstance(fns, (list, tuple))
        for fn in (fns if many else [fns]):
            name = f"{c}_{fn}" if many else c
            names.append(name)
            if fn == "median":
                medians[name] = c
                continue
            expr = _AGG_FUNCS[fn](c)
            if fn in ("sum", "mean", "std") and dict(df.dtypes)[c].startswith("decimal"):
                expr = (_money_sum(c) if fn == "sum" else
                        _money_mean(c) if fn == "mean" else expr.cast("double"))
            if fn in ("count", "nunique"):
                expr = expr.cast("long")
            aggs.append(expr.alias(name))
    out = df.groupBy(*keys).agg(*aggs) if aggs else None
    if medians:
        found = grouped_medians(df, keys, sorted(set(medians.values())))
        found = found.select(*keys, *[F.col(c).alias(name) for name, c in medians.items()])
        out = found if out is None else out.join(found, keys)
    return out.select(*keys, *names)


_ROW = "_row_order"


def with_row_order(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Add the order in which ``first`` looks at rows: ``order_by``, else the item's
    place in its order, else the place in the scan."""
    order = order_by or ("itemOrder" if "itemOrder" in df.columns else None)
    return df.withColumn(_ROW, F.coalesce(F.col(order).cast("long"), F.lit(0).cast("long")) if order
                         else F.monotonically_increasing_id())


def _first_non_null(c: str, order_by: str) -> Column:
    # min_by skips rows whose ordering is null; the value breaks ties
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(order_by), F.col(c))))


def _as_period(df: DataFrame) -> DataFrame:
    """``periodStart`` as a date; text is parsed, and becomes null where it can't be."""
    if dict(df.dtypes)["periodStart"] == "date":
        return df
    return df.withColumn("periodStart", to_timestamp_lenient("periodStart").cast("date"))


def orders_at_order_level(items: DataFrame, status: str | None = None,
                          order_by: str | None = None) -> DataFrame:
    """One row per ``orderId`` with the first non-null order-level fields.

    "First" follows ``order_by``, by default the item's place in its order if
    the table has it. The status filter runs before the collapse. Rows without
    ``orderId`` are dropped. Optional customer fields are kept when present.
    """
    require_columns(items, ["orderId"] + ORDER_FIELDS)
    df = status_filter(items, status).where(F.col("orderId").isNotNull())
    fields = ORDER_FIELDS + [c for c in CUSTOMER_FIELDS if c in items.columns]
    return with_row_order(df, order_by).groupBy("orderId").agg(
        *[_first_non_null(c, _ROW).alias(c) for c in fields])


def aov_by_type_period(items: DataFrame, status: str | None = None) -> DataFrame:
    """Average and total order value by (periodStart, customerType), null keys kept."""
    ol = _as_period(orders_at_order_level(items, status))
    return ol.groupBy("periodStart", "customerType").agg(
        F.countDistinct("orderId").cast("long").alias("orders"),
        _money_mean("orderSubTotal").alias("avg_order_subtotal"),
        _money_mean("orderTotal").alias("avg_order_total"),
        _money_sum("orderSubTotal").alias("sum_order_subtotal"),
        _money_sum("orderTotal").alias("sum_order_total"),
    )


# ---------------------------------------------------------------------------
# Customer history (E1-E3) and period metrics (A5-A8)
# ---------------------------------------------------------------------------

def order_base(items: DataFrame, status: str | None = "F") -> DataFrame:
    """Status-filtered order-level rows with a date period and the customer type stripped.

    Plans that need it more than once take it as ``base``, written once next
    to the order items (``sources.adapters.landed_order_base``).
    """
    ol = _as_period(orders_at_order_level(items, status))
    return ol.withColumn("customerType", strip_ws("customerType"))


def customer_history(base: DataFrame) -> DataFrame:
    """Per e-mail: first period, number of distinct periods, mean weeks between.

    The mean gap between consecutive distinct periods telescopes to
    ``(last - first) / (n - 1)``, so no window or per-customer list is
    needed: one aggregate over distinct (email, period) pairs.
    """
    pairs = (base.where(F.col("email").isNotNull() & F.col("periodStart").isNotNull())
             .select("email", "periodStart").distinct())
    hist = pairs.groupBy("email").agg(
        F.min("periodStart").alias("first_period"),
        F.max("periodStart").alias("last_period"),
        F.count(F.lit(1)).cast("long").alias("n_periods"))
    return hist.select(
        "email", "first_period", "n_periods",
        F.when(F.col("n_periods") >= 2,
               F.datediff("last_period", "first_period") / F.lit(7.0)
               / (F.col("n_periods") - 1)).cast("double").alias("avg_weeks"))


def display_rows(base: DataFrame, periods: DataFrame | None = None,
                 types: list[str] | None = None) -> DataFrame:
    """Rows shown in the metrics table: selected periods and customer types.

    ``periods`` is a one-column DataFrame of selected ``periodStart`` values
    (default: all); matched with a semi join so the list never passes the
    driver. Null periods and types are never shown.
    """
    df = base.where(F.col("periodStart").isNotNull() & F.col("customerType").isNotNull())
    if periods is not None:
        df = df.join(periods.select("periodStart").distinct(), "periodStart", "left_semi")
    if types is not None:
        df = df.where(F.col("customerType").isin(list(types)))
    return df


def order_metrics_by_period_type(items: DataFrame | None, status: str | None = "F",
                                 threshold: float = 100.0,
                                 periods: DataFrame | None = None,
                                 types: list[str] | None = None,
                                 base: DataFrame | None = None) -> DataFrame:
    """Revenue, orders, AOV, share over threshold, new / recurring customers,
    and mean weeks between orders per (period_start, customer_type).

    Customer history comes from all status-filtered orders, before the
    display filter. Each customer counts once per group. ``base`` (from
    ``order_base``) stands in for ``items`` and ``status``.
    """
    base = order_base(items, status) if base is None else base
    disp = display_rows(base, periods, types)
    keys = ["periodStart", "customerType"]
    om = disp.groupBy(*keys).agg(
        _money_sum("orderTotal").alias("revenue"),
        F.count("orderId").cast("long").alias("total_orders"),  # one row per order
        F.count_if(F.col("orderTotal") > F.lit(threshold)).cast("long").alias("_over"))
    out = om.select(
        F.col("periodStart").alias("period_start"),
        F.col("customerType").alias("customer_type"),
        "revenue", "total_orders",
        safe_ratio(F.col("revenue"), F.col("total_orders")).alias("aov"),
        safe_ratio(F.col("_over") * 100.0, F.col("total_orders")).alias("pct_orders_over"))
    if "email" not in base.columns:
        return out.select("*", F.lit(0).cast("long").alias("new_customers"),
                          F.lit(0.0).alias("recurring_pct"),
                          F.lit(None).cast("double").alias("avg_weeks"))
    hist = customer_history(base)
    cust = (disp.where(F.col("email").isNotNull()).select(*keys, "email").distinct()
            .join(hist, "email", "left"))
    cm = cust.groupBy(*keys).agg(
        F.count_if(F.col("first_period") == F.col("periodStart")).cast("long").alias("new_customers"),
        F.count_if(F.col("first_period") < F.col("periodStart")).alias("_rec"),
        F.count(F.lit(1)).alias("_n"),
        _fixed_avg("avg_weeks").alias("avg_weeks"))
    cm = cm.select(F.col("periodStart").alias("period_start"),
                   F.col("customerType").alias("customer_type"),
                   "new_customers",
                   safe_ratio(F.col("_rec") * 100.0, F.col("_n")).alias("recurring_pct"),
                   "avg_weeks")
    return (out.join(cm, ["period_start", "customer_type"], "left")
            .select(*out.columns,
                    F.coalesce("new_customers", F.lit(0).cast("long")).alias("new_customers"),
                    F.coalesce("recurring_pct", F.lit(0.0)).alias("recurring_pct"),
                    "avg_weeks"))


def order_kpis(items: DataFrame | None, status: str | None = "F", threshold: float = 100.0,
               periods: DataFrame | None = None, types: list[str] | None = None,
               base: DataFrame | None = None) -> DataFrame:
    """Whole-selection KPIs (one row).

    The selected periods are those of the period selector (default: all
    periods), whatever customer types are selected. New customers: the first
    period is one of them; recurring: the first period is before the earliest.
    The order part and the customer part are single-row aggregates; they are
    stacked with a union and folded with ``max`` instead of being joined.
    """
    base = order_base(items, status) if base is None else base
    disp = display_rows(base, periods, types)
    kp = disp.agg(_money_sum("orderTotal").alias("revenue"),
                  F.count("orderId").cast("long").alias("total_orders"),
                  F.count_if(F.col("orderTotal") > F.lit(threshold)).alias("_over"))
    ratios = [F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
              F.coalesce("total_orders", F.lit(0).cast("long")).alias("total_orders"),
              safe_ratio(F.col("revenue"), F.col("total_orders")).alias("aov"),
              safe_ratio(F.col("_over") * 100.0, F.col("total_orders")).alias("pct_orders_over")]
    if "email" not in base.columns:
        return kp.select(*ratios, F.lit(0).cast("long").alias("new_customers"),
                         F.lit(0.0).alias("recurring_pct"), F.lit(None).cast("double").alias("avg_weeks_between"))
    selected = (base if periods is None else periods).select("periodStart").where(F.col("periodStart").isNotNull())
    sel = selected.select(F.col("periodStart").alias("first_period")).distinct().withColumn("_sel", F.lit(True))
    earliest = selected.agg(F.min("periodStart").alias("_earliest"))
    cust = (disp.where(F.col("email").isNotNull()).select("email").distinct()
            .join(customer_history(base), "email", "left")
            .join(sel, "first_period", "left")
            .withColumn("_earliest", earliest.scalar()))
    ca = cust.agg(F.count_if(F.col("_sel")).alias("new_customers"),
                  F.count(F.lit(1)).alias("_n"),
                  F.count_if(F.col("first_period") < F.col("_earliest")).alias("_rec"),
                  _fixed_avg("avg_weeks").alias("avg_weeks_between"))
    both = kp.unionByName(ca, allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return row.select(*ratios,
                      F.coalesce("new_customers", F.lit(0)).cast("long").alias("new_customers"),
                      safe_ratio(F.col("_rec") * 100.0, F.col("_n")).alias("recurring_pct"),
                      "avg_weeks_between")


def new_customers_detail(items: DataFrame | None, status: str | None = "F",
                         periods: DataFrame | None = None,
                         types: list[str] | None = None,
                         base: DataFrame | None = None) -> DataFrame:
    """One row per (email, type, period) where the period is the customer's first.

    Without an e-mail column there are none; without names the name is "".
    """
    base = order_base(items, status) if base is None else base
    if "email" not in base.columns:
        return base.where(F.lit(False)).select(
            F.lit("").alias("email"), F.lit("").alias("name"), F.col("customerType").alias("customer_type"),
            F.col("periodStart").alias("first_period"))
    name = F.min_by("customerName", "orderId") if "customerName" in base.columns else F.first(F.lit(""))
    disp = display_rows(base, periods, types).where(F.col("email").isNotNull())
    hist = customer_history(base).select("email", "first_period")
    # reduce to one row per (email, type, period) before joining the history
    per = disp.groupBy("email", "customerType", "periodStart").agg(name.alias("name"))
    firsts = (per.join(hist, "email")
              .where(F.col("first_period") == F.col("periodStart")))
    return firsts.select(F.col("email"), F.col("name"),
                         F.col("customerType").alias("customer_type"),
                         F.col("periodStart").alias("first_period")) \
        .orderBy("first_period", "customer_type", "email")


def _round_even(c: str, digits: int) -> Column:
    """numpy's rounding: scale, round half to even, scale back."""
    unit = F.lit(10.0 ** digits)
    return (F.rint(F.col(c) * unit) / unit).alias(c)


def metrics_grid(metrics: DataFrame) -> DataFrame:
    """Presentation copy: MM/dd/yy dates, 2-digit money, 1-digit percentages
    (half-even rounding like numpy)."""
    return metrics.orderBy("period_start", "customer_type").select(
        F.date_format("period_start", "MM/dd/yy").alias("period_start"),
        "customer_type", _round_even("revenue", 2), "total_orders", _round_even("aov", 2),
        _round_even("pct_orders_over", 1), "new_customers", _round_even("recurring_pct", 1),
        _round_even("avg_weeks", 1))

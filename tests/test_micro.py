"""Golden micro-tables for the edge rules of each operator family."""

import datetime as dt
import math
from decimal import Decimal

import pytest

from basketry.operators import customers as C
from basketry.operators import orders as O
from basketry.operators import periods as P
from basketry.operators import products as PR
from basketry.schemas import CUSTOMERS, ORDER_ITEMS, MissingColumnsError, require_columns

D = Decimal
AS_OF = dt.datetime(1996, 6, 30)


def items(spark, rows):
    cols = [f.name for f in ORDER_ITEMS.fields]
    full = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(full, ORDER_ITEMS)


def item(order, period=None, ctype="A", sub=None, total=None, status="F", email=None,
         cid=None, name=None, qty=1.0, product="p", producer="s"):
    return dict(orderId=order, periodStart=period, customerType=ctype, orderSubTotal=sub,
                orderTotal=total, orderStatus=status, email=email, customerId=cid,
                customerName=name, locationName=None, qty=qty, productName=product,
                producerName=producer)


W1, W2, W3 = dt.date(1996, 1, 1), dt.date(1996, 1, 8), dt.date(1996, 1, 15)


# -- orders --------------------------------------------------------------------

def test_order_level_collapse_takes_money_from_any_row(spark):
    df = items(spark, [item(1, W1, total=None), item(1, W1, sub=D("5.00"), total=D("7.00")),
                       item(None, W1, total=D("99.00")), item(2, None, "B")])
    got = {r["orderId"]: r for r in O.orders_at_order_level(df).collect()}
    assert set(got) == {1, 2}                      # null orderId dropped
    assert got[1]["orderTotal"] == D("7.00") and got[1]["orderSubTotal"] == D("5.00")
    assert got[2]["orderTotal"] is None


def test_order_level_first_non_null_by_order_column(spark):
    df = items(spark, [item(1, W1, ctype=None), item(1, W1, ctype="X"), item(1, W1, ctype="Y")])
    df = df.withColumn("line", df.qty)
    from pyspark.sql import functions as F
    df = df.withColumn("line", F.monotonically_increasing_id())
    out = O.orders_at_order_level(df, order_by="line").collect()
    assert out[0]["customerType"] == "X"


def test_aov_keeps_null_keys_and_all_null_sums_to_zero(spark):
    df = items(spark, [item(1, None, "A", total=None), item(2, W1, None, total=D("10.00")),
                       item(3, W1, None, total=D("20.00"), sub=D("15.00"))])
    got = {(r["periodStart"], r["customerType"]): r for r in O.aov_by_type_period(df).collect()}
    assert got[(None, "A")]["sum_order_total"] == 0.0
    assert got[(None, "A")]["avg_order_total"] is None
    assert got[(W1, None)]["orders"] == 2
    assert got[(W1, None)]["avg_order_total"] == 15.0
    assert got[(W1, None)]["avg_order_subtotal"] == 15.0


def test_status_filter_runs_before_collapse(spark):
    df = items(spark, [item(1, W1, total=D("1.00"), status="F"), item(2, W1, total=D("2.00"), status="O")])
    assert O.orders_at_order_level(df, "F").count() == 1
    assert O.orders_at_order_level(df, "All").count() == 2


def test_summarize_counts_rows_not_orders(spark):
    df = items(spark, [item(1, W1, total=D("10.00"), cid=1, qty=2.0), item(1, W1, cid=1, qty=3.0),
                       item(2, W1, total=D("5.00"), cid=None, qty=1.0)])
    r = O.summarize_orders(df).first()
    assert (r.num_orders, r.total_revenue, r.total_items, r.unique_customers) == (3, 15.0, 6.0, 1)
    r2 = O.summarize_orders(df.select("orderId")).first()
    assert (r2.total_revenue, r2.total_items, r2.unique_customers) == (0.0, 0.0, 0)


def test_aggregate_orders_multi_function_names(spark):
    df = items(spark, [item(1, W1, "A", total=D("10.00")), item(2, W1, "A", total=D("30.00")),
                       item(3, W1, None, total=D("1.00"))])
    out = O.aggregate_orders(df, ["customerType"], {"orderTotal": ["sum", "mean"], "qty": "max"})
    rows = out.collect()
    assert out.columns == ["customerType", "orderTotal_sum", "orderTotal_mean", "qty"]
    assert len(rows) == 1 and rows[0]["orderTotal_sum"] == 40.0 and rows[0]["orderTotal_mean"] == 20.0


def test_metrics_new_recurring_and_weeks(spark):
    # e1: orders in W1 (two orders, counted once) and W3; e2: only W3; e3 only W2 (type B)
    df = items(spark, [
        item(1, W1, "A", total=D("150.00"), email="e1", name="One"),
        item(2, W1, " A\t", total=D("50.00"), email="e1", name="One"),
        item(3, W3, "A", total=D("10.00"), email="e1", name="One"),
        item(4, W3, "A", total=D("20.00"), email="e2", name="Two"),
        item(5, W2, "B", total=None, email="e3", name="Three"),
        item(6, W2, "B", total=D("5.00"), email=None),
    ])
    m = {(r["period_start"], r["customer_type"]): r
         for r in O.order_metrics_by_period_type(df, "F", 100.0).collect()}
    w1 = m[(W1, "A")]
    assert (w1.revenue, w1.total_orders, w1.aov, w1.pct_orders_over) == (200.0, 2, 100.0, 50.0)
    assert (w1.new_customers, w1.recurring_pct) == (1, 0.0)
    assert w1.avg_weeks == 2.0                    # e1: W1 -> W3 is two weeks
    w3 = m[(W3, "A")]
    assert (w3.new_customers, w3.recurring_pct) == (1, 50.0)
    assert w3.avg_weeks == 2.0                    # e2 has a single period -> ignored
    w2 = m[(W2, "B")]
    assert (w2.revenue, w2.total_orders, w2.new_customers) == (5.0, 2, 1)
    assert w2.avg_weeks is None
    k = O.order_kpis(df, "F", 100.0).first()
    assert (k.revenue, k.total_orders, k.new_customers) == (235.0, 6, 3)
    assert k.pct_orders_over == pytest.approx(100 / 6)
    assert k.recurring_pct == 0.0 and k.avg_weeks_between == 2.0
    det = {(r.email, r.first_period) for r in O.new_customers_detail(df, "F").collect()}
    assert det == {("e1", W1), ("e2", W3), ("e3", W2)}


def test_metrics_without_email_column(spark):
    df = items(spark, [item(1, W1, total=D("10.00"))]).drop("email")
    r = O.order_metrics_by_period_type(df, "F").first()
    assert (r.new_customers, r.recurring_pct, r.avg_weeks) == (0, 0.0, None)


def test_required_columns_reports_sorted_missing():
    class Fake:
        columns = ["orderId"]
    with pytest.raises(MissingColumnsError) as e:
        require_columns(Fake(), ["qty", "orderTotal", "orderId"])
    assert e.value.missing == ["orderTotal", "qty"]


# -- periods ---------------------------------------------------------------------

def test_week_comparison_fills_gaps_and_infinity(spark):
    rows = [(W1, "A", 10.0, 1, 10.0, 0.0, 0, 0.0), (W3, "A", 30.0, 3, 10.0, 0.0, 1, 50.0),
            (dt.date(1996, 1, 29), "A", 0.0, 0, 0.0, 0.0, 0, 0.0),
            (dt.date(1996, 2, 5), "A", 0.0, 0, 0.0, 0.0, 0, 0.0)]
    m = spark.createDataFrame(rows, "period_start date, customer_type string, revenue double, "
                                    "total_orders long, aov double, pct_orders_over double, "
                                    "new_customers long, recurring_pct double")
    out = {r.period_label: r for r in P.period_comparison(m, "W").collect()}
    labels = sorted(out)
    assert labels[0] == dt.date(1996, 1, 7)       # Sunday label
    assert len(labels) == 6                        # W1..Feb 5 weekly, gaps included
    assert out[dt.date(1996, 1, 7)].revenue_pct is None
    assert out[dt.date(1996, 1, 14)].revenue == 0.0
    assert out[dt.date(1996, 1, 14)].revenue_pct == -100.0
    assert out[dt.date(1996, 1, 21)].revenue_pct == math.inf        # 0 -> 30
    assert out[dt.date(1996, 1, 21)].new_customers_pct == math.inf
    assert out[dt.date(1996, 2, 11)].revenue_pct is None            # 0 -> 0
    mo = {r.period_label: r for r in P.period_comparison(m, "ME").collect()}
    assert sorted(mo) == [dt.date(1996, 1, 31), dt.date(1996, 2, 29)]
    assert mo[dt.date(1996, 1, 31)].revenue == 40.0
    yr = P.period_comparison(m, "YE").collect()
    assert [r.period_label for r in yr] == [dt.date(1996, 12, 31)]


def test_period_dimension_iso_weeks(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2021, 1, 4),), (None,)],
                               "periodStart date")
    got = {r.periodStart: r.week_key for r in P.period_dimension(df).collect()}
    assert got == {dt.date(2021, 1, 3): "2020-W53", dt.date(2021, 1, 4): "2021-W01"}


def test_rolling_window(spark):
    df = spark.createDataFrame([(dt.date(1996, 6, 1),), (dt.date(1995, 1, 1),)], "d date")
    assert P.rolling_date_window(df, "d", last_days=100).count() == 1
    assert P.rolling_date_window(df, "d").count() == 2
    assert P.rolling_date_window(df, "d", start="1995-01-01", end="1995-01-01").count() == 1


# -- customers -----------------------------------------------------------------------

def cust(spark, rows):
    cols = [f.name for f in CUSTOMERS.fields]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], CUSTOMERS)


def c_row(cid, days_last=None, days_first=None, orders=1, sales=100.0):
    last = AS_OF - dt.timedelta(days=days_last) if days_last is not None else None
    first = AS_OF - dt.timedelta(days=days_first) if days_first is not None else last
    return dict(customerId=cid, fullName=f"n{cid}", email=f"c{cid}@x", totalOrders=orders,
                totalSales=sales, firstOrder=first, lastOrder=last, dateEntered=first)


def test_fewer_than_five_active_is_insufficient(spark):
    four = cust(spark, [c_row(i, 10, 500) for i in range(4)] + [c_row(9)])
    assert {r.segment for r in C.segment_customers(four, AS_OF).collect()} == {"Insufficient Data"}
    five = cust(spark, [c_row(i, 10, 500) for i in range(5)])
    assert "Insufficient Data" not in {r.segment for r in C.segment_customers(five, AS_OF).collect()}


def test_segment_boundaries(spark):
    # thresholds come out as r_p33 = 5, f_p66 = 3, m_p66 = 300
    base = [c_row(100 + i, 5, 1000, orders=3, sales=300.0) for i in range(20)]
    rows = base + [
        c_row(1, 90, 1000, orders=5, sales=500.0),
        c_row(2, 91, 1000, orders=5, sales=500.0),
        c_row(3, 180, 1000, orders=5, sales=500.0),
        c_row(4, 181, 1000, orders=5, sales=500.0),
        c_row(5, 270, 1000, orders=5, sales=500.0),
        c_row(6, 271, 1000, orders=5, sales=500.0),
        c_row(7, 10, 90, orders=2, sales=1.0),
        c_row(8, 10, 91, orders=2, sales=1.0),
        c_row(9, 10, 90, orders=3, sales=1.0),
        c_row(12, 90, 1000, orders=1, sales=500.0),
        c_row(13, 91, 1000, orders=1, sales=500.0),
        c_row(10, None, None, orders=0, sales=0.0),
        dict(c_row(11, 10, 500), totalOrders=0, totalSales=0.0),  # a last order, 0 counted
    ]
    df = cust(spark, rows)
    t = C.rfm_thresholds(C.customer_recency(df, AS_OF))
    assert (t.n_active, t.r_p33, t.f_p66, t.m_p66) == (31, 5.0, 3.0, 300.0)
    s = C.segment_customers(df, AS_OF)
    seg = {r.customerId: r.segment for r in s.collect()}
    assert seg[100] == "Champions"
    assert [seg[i] for i in (1, 2, 3, 4, 5, 6)] == ["Loyal", "Loyal", "Loyal", "At-Risk",
                                                    "At-Risk", "Lost"]
    assert [seg[i] for i in (7, 8, 9)] == ["New", "Regular", "Regular"]
    assert [seg[i] for i in (12, 13)] == ["Regular", "At-Risk"]
    assert seg[10] == "Never Ordered" and seg[11] == "Occasional"
    occ = C.lookalike_occasional_recent(s).collect()
    assert [r.customerId for r in occ] == [11]


def test_bad_values_coerced(spark):
    df = spark.createDataFrame([("garbage", "x", "NaN"), ("1996-06-29", "3", "12.5")],
                               "lastOrder string, totalOrders string, totalSales string")
    out = C.customer_recency(df, AS_OF).collect()
    assert out[0].lastOrder is None and out[0].totalOrders == 0.0 and out[0].totalSales == 0.0
    assert out[0].days_since_last_order is None
    assert out[1].days_since_last_order == 1 and out[1].totalOrders == 3.0


def test_clv_rules(spark):
    rows = [c_row(1, 5, 15, orders=1, sales=100.0),     # 15 days < half a month -> 0 / month
            c_row(2, 5, 16, orders=1, sales=100.0),     # 16 days -> rate counted
            c_row(3, 5, 400, orders=2, sales=-50.0)]    # negative sales -> historical 0
    seg = C.customer_recency(cust(spark, rows), AS_OF).withColumn("segment", C.F.lit("X"))
    clv = {r.customerId: r for r in C.customer_clv(seg, 12).collect()}
    assert clv[1].orders_per_month == 0.0 and clv[1].projected_clv == 0.0
    assert clv[2].orders_per_month == pytest.approx(1 / (16 / 30.44))
    assert clv[3].historical_clv == 0.0 and clv[3].avg_order_value == 0.0
    assert {r.clv_tier for r in clv.values()} <= {"High", "Medium", "Low"}
    two = C.customer_clv(seg.where("customerId < 3"), 12).collect()
    assert {r.clv_tier for r in two} == {"High"}         # < 3 active: thresholds 0
    with pytest.raises(ValueError):
        C.customer_clv(seg, 7)


def test_segment_semi_join_normalises_email(spark):
    seg = spark.createDataFrame([(" A@X.com\t", "Champions"), (None, "Champions"), ("b@x", "Lost")],
                                "email string, segment string")
    df = items(spark, [item(1, W1, email="a@x.COM "), item(2, W1, email=None),
                       item(3, W1, email="b@x")])
    got = [r.orderId for r in C.segment_orders_semi_join(df, seg, "Champions").collect()]
    assert got == [1]


# -- products ------------------------------------------------------------------------

def test_top_k_per_group_matches_brute_force_on_a_hot_group(spark):
    import random
    rnd = random.Random(7)
    rows = [("hot", f"p{i}", float(rnd.randint(0, 50))) for i in range(3000)]
    rows += [("cold", f"q{i}", float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "producerName string, productName string, units double")
    from pyspark.sql import functions as F
    got = PR.top_k_per_group(df, ["producerName"], [F.desc("units"), F.asc("productName")], 5,
                             "productName", buckets=16)
    got = sorted((r.producerName, r.productName, r.rank) for r in got.collect())
    want = []
    for g in ("hot", "cold"):
        sel = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))[:5]
        want += [(g, r[1], i + 1) for i, r in enumerate(sel)]
    assert got == sorted(want)


def test_producer_unknown_and_strip(spark):
    df = items(spark, [item(1, W1, producer=None), item(2, W1, producer=" s\t")])
    got = sorted(r.producerName for r in PR.product_base(df).collect())
    assert got == ["Unknown", "s"]


def test_aggregate_orders_function_table(spark):
    df = items(spark, [item(1, W1, "A", total=D("10.00"), qty=1.0),
                       item(2, W1, "A", total=D("20.00"), qty=3.0),
                       item(2, W1, "A", total=None, qty=5.0),
                       item(3, W1, "B", total=D("40.00"), qty=2.0)])
    out = O.aggregate_orders(df, ["customerType"],
                             {"qty": ["median", "std", "min", "max", "count"],
                              "orderId": "nunique", "orderTotal": "mean"})
    got = {r.customerType: r for r in out.collect()}
    a = got["A"]
    assert (a.qty_median, a.qty_min, a.qty_max, a.qty_count) == (3.0, 1.0, 5.0, 3)
    assert a.qty_std == pytest.approx(2.0)
    assert a.orderId == 2 and a.orderTotal == 15.0
    assert got["B"].qty_std is None


def test_recompute_ratios_per_bin(spark):
    rows = [(W1, "A", 100.0, 2, 50.0, 0.0, 0, 0.0), (W1, "B", 300.0, 1, 300.0, 0.0, 0, 0.0)]
    m = spark.createDataFrame(rows, "period_start date, customer_type string, revenue double, "
                                    "total_orders long, aov double, pct_orders_over double, "
                                    "new_customers long, recurring_pct double")
    summed = P.period_comparison(m, "W").first()
    assert summed.aov == 350.0                      # the reference sums AOV per bin
    ratio = P.period_comparison(m, "W", recompute_ratios=True).first()
    assert ratio.aov == pytest.approx(400.0 / 3)


def test_segment_profile_unknown_and_actions(spark):
    seg = spark.createDataFrame([("Champions", 2, 10.0, 5), (None, 1, 1.0, None), ("Odd", 1, 0.0, 3)],
                                "segment string, totalOrders long, totalSales double, "
                                "days_since_last_order long")
    prof = {r.segment: r for r in C.segment_profile(seg).collect()}
    assert prof["Champions"].suggested_action == C.SEGMENT_ACTIONS["Champions"]
    assert prof["Unknown"].suggested_action == "" and prof["Odd"].suggested_action == ""
    assert prof["Unknown"].avg_days_since_last is None


def test_clv_histogram_single_value(spark):
    seg = C.customer_recency(cust(spark, [c_row(i, 5, 400, orders=2, sales=100.0) for i in range(4)]),
                             AS_OF).withColumn("segment", C.F.lit("X"))
    hist = C.clv_histogram(C.customer_clv(seg, 12)).collect()
    assert [(r.bin, r.customers) for r in hist] == [(1, 4)]


ITEM = ("orderId long, periodStart string, customerType string, orderSubTotal double, orderTotal double, "
        "orderStatus string, email string, customerName string")


def test_kpis_take_periods_from_the_selector_not_from_the_type(spark):
    rows = [(1, "2024-01-01", "A", 1.0, 200.0, "F", "x@x", "X"), (2, "2024-01-08", "B", 1.0, 300.0, "F", "x@x", "X")]
    items = spark.createDataFrame(rows, ITEM)
    kpi = O.order_kpis(items, "F", types=["B"]).first()
    assert (kpi.revenue, kpi.new_customers, kpi.recurring_pct) == (300.0, 1, 0.0)
    later = spark.createDataFrame([("2024-01-08",)], "p string").selectExpr("cast(p as date) as periodStart")
    kpi = O.order_kpis(items, "F", types=["B"], periods=later).first()
    assert (kpi.new_customers, kpi.recurring_pct) == (0, 100.0)


def test_kpis_and_detail_without_optional_columns(spark):
    items = spark.createDataFrame([(1, "2024-01-01", "A", 1.0, 200.0, "F", "x@x", "X")], ITEM)
    kpi = O.order_kpis(items.drop("email"), "F").first()
    assert (kpi.total_orders, kpi.new_customers, kpi.recurring_pct, kpi.avg_weeks_between) == (1, 0, 0.0, None)
    assert O.new_customers_detail(items.drop("email"), "F").collect() == []
    assert [r.name for r in O.new_customers_detail(items.drop("customerName"), "F").collect()] == [""]


def test_first_non_null_keeps_the_fields_of_the_earlier_row(spark):
    df = spark.createDataFrame([(1, 1, "2024-01-01", "A", None, 5.0, "F"), (1, 2, "2024-01-08", "B", 2.0, 9.0, "F")],
                               "orderId long, itemOrder long, periodStart string, customerType string, "
                               "orderSubTotal double, orderTotal double, orderStatus string")
    row = O.orders_at_order_level(df.repartition(2)).first()
    assert (row.periodStart, row.customerType, row.orderSubTotal, row.orderTotal) == ("2024-01-01", "A", 2.0, 5.0)


def test_text_periods_are_parsed(spark):
    rows = [(1, "bad", "A", 1.0, 2.0, "F", "x@x", "X"), (2, "2024-01-01", "A", 1.0, 2.0, "F", "x@x", "X")]
    got = {str(r.periodStart) for r in O.aov_by_type_period(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == {"None", "2024-01-01"}


def test_offsets_are_converted_to_utc(spark):
    df = spark.createDataFrame([(1, "1996-06-29T23:30:00-05:00", 1)], "customerId long, lastOrder string, totalOrders long")
    assert C.customer_recency(df).first().days_since_last_order == -1


def test_availability_of_null_quantities_is_zero(spark):
    df = spark.createDataFrame([("p", "x", None, None, None)], "producer string, productName string, quantityListed double, "
                               "quantityAvailable double, quantitySold double")
    assert tuple(PR.availability_by_product(df).first())[2:] == (0.0, 0.0, 0.0)


def test_bad_product_dates_are_null(spark):
    df = spark.createDataFrame([("bad", "p"), ("2024-01-01", "p")], "periodStart string, producerName string")
    assert sorted(str(r.periodStart) for r in PR.product_base(df).collect()) == ["2024-01-01", "None"]

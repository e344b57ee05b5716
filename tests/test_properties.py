"""Properties that must hold on the real tables, and distributed helpers vs brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.quantiles import exact_quantiles, exact_quantiles_multi
from basketry.operators import customers as C
from basketry.operators import orders as O
from basketry.operators import periods as P
from basketry.plans.registry import queries
from basketry.sources import files as S
from basketry.sources.adapters import landed_customers, landed_order_items


def test_segments_partition_customers(spark, sf_dir):
    seg = C.segment_customers(landed_customers(spark, sf_dir))
    total = seg.count()
    counts = {r.segment: r["count"] for r in seg.groupBy("segment").count().collect()}
    assert sum(counts.values()) == total
    assert set(counts) <= set(C.SEGMENT_ORDER)


def test_metrics_add_up_to_kpis_and_comparisons(spark, sf_dir):
    items = landed_order_items(spark, sf_dir)
    m = O.order_metrics_by_period_type(items, "F", 250000.0)
    k = O.order_kpis(items, "F", 250000.0).first()
    tot = m.agg(F.sum("revenue").alias("r"), F.sum("total_orders").alias("n")).first()
    assert tot.n == k.total_orders
    assert tot.r == pytest.approx(k.revenue, rel=1e-12)
    for freq in ("W", "ME", "YE"):
        c = P.period_comparison(m, freq).agg(F.sum("revenue").alias("r"),
                                             F.sum("total_orders").alias("n")).first()
        assert c.n == k.total_orders
        assert c.r == pytest.approx(k.revenue, rel=1e-12)


def test_input_row_order_does_not_change_results(spark, sf_dir):
    items = landed_order_items(spark, sf_dir)
    shuffled = items.repartition(7, F.rand(11))
    a = sorted(map(tuple, O.order_metrics_by_period_type(items, "F").collect()))
    b = sorted(map(tuple, O.order_metrics_by_period_type(shuffled, "F").collect()))
    assert a == b


def test_higher_projected_clv_never_gets_lower_tier(spark, sf_dir):
    clv = C.customer_clv(C.segment_customers(landed_customers(spark, sf_dir)), 12)
    rank = {"Low": 0, "Medium": 1, "High": 2}
    rows = sorted(((r.projected_clv, rank[r.clv_tier]) for r in clv.collect()
                   if r.clv_tier != "No Orders"))
    tiers = [t for _, t in rows]
    assert tiers == sorted(tiers)


@pytest.mark.parametrize("n", [1, 2, 7, 500, 5000, 20000])
def test_exact_quantiles_equal_numpy(spark, n):
    rnd = random.Random(n)
    vals = [float(rnd.randint(-50, 50)) if i % 3 else rnd.random() * 1000 for i in range(n)]
    if n > 1:
        vals[0] = None
    df = spark.createDataFrame([(v,) for v in vals] + [(float("nan"),)], "x double")
    probs = [0.0, 0.25, 0.33, 0.5, 0.66, 0.99, 1.0]
    got = exact_quantiles(df, "x", probs, accuracy=100)
    clean = np.array([v for v in vals if v is not None])
    want = np.quantile(clean, probs)
    assert got == pytest.approx(list(want), rel=1e-12, abs=1e-9)
    multi, counts = exact_quantiles_multi(df, {"x": probs}, accuracy=100)
    assert counts["x"] == len(clean)
    assert multi["x"] == pytest.approx(list(want), rel=1e-12, abs=1e-9)


def test_exact_quantiles_with_heavy_ties(spark):
    rnd = random.Random(3)
    vals = [float(rnd.choice([1, 2, 2, 3, 3, 3])) for _ in range(30000)] + [0.5, 9.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.33, 0.5, 0.66, 0.9, 1.0]
    got = exact_quantiles(df, "x", probs, accuracy=100)
    assert got == pytest.approx(list(np.quantile(np.array(vals), probs)), rel=1e-12)


def test_exact_quantiles_with_infinity(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (-inf, -inf, 1.0, 2.0, inf)], "x double")
    assert exact_quantiles(df, "x", [0.0, 0.5, 0.6, 0.75, 1.0]) == [-inf, 1.0, pytest.approx(1.4), 2.0, inf]
    assert exact_quantiles(df, "x", [0.8]) == [inf]


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", [0.5]) == [None]


def test_json_flatten_rules(spark, tmp_path):
    recs = [{"id": 1, "customer": {"name": "a", "type": "t"}, "items": [{"product": "p", "qty": 2}]},
            {"id": 2, "customer": {"name": "b"}, "items": []},
            {"id": 3, "items": [{"product": "q", "qty": 1}, {"product": "r", "qty": 4}]}]
    path = tmp_path / "docs.json"
    path.write_text("\n".join(json.dumps(r) for r in recs))
    df = S.read_json(spark, str(path))
    flat = S.json_flatten(df)
    assert set(flat.columns) == {"id", "customer.name", "customer.type", "items"}
    rows = S.json_flatten(df, "items", ["id", ["customer", "name"], "missing.path"]).collect()
    assert [(r["product"], r["id"], r["customer.name"], r["missing.path"]) for r in
            sorted(rows, key=lambda r: r["product"])] == [("p", 1, "a", None), ("q", 3, None, None),
                                                          ("r", 3, None, None)]


def test_csv_round_trip_keeps_padding_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("  x ", None, 1.5), ("y", "z", None)], "a string, b string, c double")
    out = S.csv_sink(df, str(tmp_path / "out"))
    back = S.csv_scan(spark, out, df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    inferred = S.csv_scan(spark, out)
    assert dict(inferred.dtypes)["c"] == "double"


def test_csv_follows_rfc_4180(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('name,id,note\n"a ""b"" c",1,"two\nlines"\n,2,""\n"x,y",3,plain\n')
    rows = S.csv_scan(spark, str(path), T.StructType.fromDDL("id long, name string, note string")).collect()
    assert sorted(map(tuple, rows)) == [(1, 'a "b" c', "two\nlines"), (2, None, ""), (3, "x,y", "plain")]
    with pytest.raises(ValueError):
        S.csv_scan(spark, str(path), T.StructType.fromDDL("id long, missing string"))


def test_csv_round_trip_is_lossless(spark, tmp_path):
    values = ["", None, "a\nb", "a\r\nb", 'quote " inside', '"', ",", " padded ", "\\back\\", "null", "é\U0001F600"]
    df = spark.createDataFrame([(i, v, None if i % 2 else 1.5) for i, v in enumerate(values)],
                               "i long, v string, d double")
    back = S.csv_scan(spark, S.csv_sink(df, str(tmp_path / "out")), df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_describe_all_is_exact_and_skips_nan(spark):
    rows = [(10**15 + k, 2 * 10**18 + k, float("nan") if k == 0 else float(k), -(2**63) if k else 2**63 - 1)
            for k in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, x double, e long")
    got = {r.column: r for r in S.describe_all(df).collect()}
    std = math.sqrt(sum((k - 499.5) ** 2 for k in range(1000)) / 999)
    assert got["a"]["std"] == pytest.approx(std, rel=1e-12) and got["b"]["std"] == pytest.approx(std, rel=1e-12)
    assert got["a"]["mean"] == 10**15 + 499.5 and got["b"]["mean"] == 2 * 10**18 + 499.5
    assert (got["x"]["count"], got["x"]["min"], got["x"]["max"], got["x"]["mean"]) == (999, 1.0, 999.0, 500.0)
    assert got["e"]["std"] == pytest.approx(2.0**64 / math.sqrt(1000), rel=1e-12)


def test_describe_all_numeric_and_text(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.0, "b"), (None, None)], "x double, s string")
    rows = {r.column: r for r in S.describe_all(df).collect()}
    assert rows["x"]["count"] == 3 and rows["x"]["p50"] == 2.0 and rows["x"]["max"] == 4.0
    assert rows["s"]["unique"] == 2 and rows["s"]["top"] == "b" and rows["s"]["freq"] == 2


def test_preview_is_ordered_top_n(spark, sf_dir):
    rows = queries()["preview"](spark, sf_dir).collect()
    ids = [r.orderId for r in rows]
    assert ids == sorted(ids) and len(ids) == 20


def test_exact_quantiles_multi_columns_share_rounds(spark):
    rnd = random.Random(5)
    rows = [(float(rnd.randint(0, 9)), rnd.random() * 100, None if i % 7 == 0 else float(i))
            for i in range(6000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    spec = {"a": [0.1, 0.5, 0.9], "b": [0.33, 0.66], "c": [0.0, 0.25, 1.0]}
    got, counts = exact_quantiles_multi(df, spec, accuracy=50)
    for col, idx in (("a", 0), ("b", 1), ("c", 2)):
        vals = np.array([r[idx] for r in rows if r[idx] is not None])
        assert counts[col] == len(vals)
        assert got[col] == pytest.approx(list(np.quantile(vals, spec[col])), rel=1e-12)

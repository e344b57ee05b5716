"""ML outputs checked by properties (another library's forest cannot be matched)."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import ml as M
from basketry.operators.customers import segment_customers
from basketry.sources.adapters import landed_customers

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def result(spark):
    seg = segment_customers(landed_customers(spark, SF01))
    return seg, M.run_customer_ml(seg, num_trees=20, max_depth=8)


def test_scores_cover_every_customer_in_range(result):
    seg, res = result
    assert res.scored.count() == seg.count()
    bad = res.scored.where((F.col("churn_risk_score") < 0) | (F.col("churn_risk_score") > 100)
                           | (F.col("upgrade_potential_score") < 0)
                           | (F.col("upgrade_potential_score") > 100)).count()
    assert bad == 0
    assert res.scored.where(F.col("churn_risk_score").isNull()).count() == 0


def test_auc_and_importances(result):
    _, res = result
    for t in (res.churn, res.upgrade):
        assert t.auc is not None and t.auc > 0.9
        assert sum(t.importances) == pytest.approx(1.0)
        assert len(t.importances) == len(M.ML_FEATURES)


def test_top_lists_exclude_segments(result):
    _, res = result
    wb = M.top_winback(res.scored).collect()
    assert len(wb) == 20 and not {r.segment for r in wb} & {"Lost", "Never Ordered"}
    scores = [r.churn_risk_score for r in wb]
    assert scores == sorted(scores, reverse=True)
    up = M.top_upsell(res.scored).collect()
    assert not {r.segment for r in up} & set(M.UPSELL_EXCLUDE)


def test_untrained_below_ten_per_class(spark):
    rows = [(i, "Lost" if i < 9 else "Champions", float(i), 1.0, float(i), 100.0) for i in range(40)]
    seg = spark.createDataFrame(rows, "customerId long, segment string, totalOrders double, "
                                      "totalSales double, days_since_last_order double, "
                                      "customer_age_days double")
    res = M.run_customer_ml(seg, num_trees=5, max_depth=3, cross_validate=False)
    assert res.churn.model is None                      # 9 positives < 10
    assert res.scored.where(F.col("churn_risk_score").isNotNull()).count() == 0
    rows10 = [(i, "Lost" if i < 10 else "Champions", float(i), 1.0, float(i), 100.0) for i in range(40)]
    seg10 = spark.createDataFrame(rows10, seg.schema)
    res10 = M.run_customer_ml(seg10, num_trees=5, max_depth=3, cross_validate=False)
    assert res10.churn.model is not None


def test_every_fold_gets_its_share_of_each_class(spark):
    df = spark.range(60).withColumn("label", (F.col("id") % 6 == 0).cast("int"))        # 10 positives
    numbered = M.stratified_number(df, "label", [F.col("id")], 42)
    for label, n in ((0, 50), (1, 10)):
        rows = numbered.where(F.col("label") == label)
        assert sorted(r["_number"] for r in rows.collect()) == list(range(n))
        folds = {r["fold"]: r["count"] for r in rows.groupBy((F.col("_number") % 5).alias("fold")).count().collect()}
        assert folds == {k: n // 5 for k in range(5)}
    again = M.stratified_number(df.repartition(7), "label", [F.col("id")], 42)
    assert again.exceptAll(numbered).count() == 0


def test_report_lists_classes_without_support_or_prediction(spark):
    cm = spark.createDataFrame([("a", "a", 3), ("a", "c", 1), ("b", "a", 2)], "actual string, predicted string, n long")
    got = {r["class"]: tuple(r)[1:] for r in M.report_from_counts(cm).collect()}
    assert got["a"] == (pytest.approx(0.6), 0.75, pytest.approx(2 / 3), 4)
    assert got["b"] == (0.0, 0.0, 0.0, 2) and got["c"] == (0.0, 0.0, 0.0, 0)
    assert got["accuracy"][0] == 0.5 and got["macro avg"][0] == pytest.approx(0.2) and got["accuracy"][3] == 6


def test_classification_report_shape(spark):
    seg = segment_customers(landed_customers(spark, SF01))
    feat = M.customer_features(seg)
    rep = {r["class"]: r for r in M.classification_report(feat, "segment", M.ML_FEATURES,
                                                           key="customerId", num_trees=10).collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= set(rep)
    assert 0.0 <= rep["accuracy"]["precision"] <= 1.0
    n = rep["accuracy"]["support"]
    assert sum(r["support"] for k, r in rep.items() if k not in ("accuracy", "macro avg",
                                                                 "weighted avg")) == n


def test_top_lists_skip_untrained_scores(spark):
    rows = [(i, "Regular", 1.0, 1.0, 5.0, 100.0) for i in range(5)]
    seg = spark.createDataFrame(rows, "customerId long, segment string, totalOrders double, "
                                      "totalSales double, days_since_last_order double, "
                                      "customer_age_days double")
    res = M.run_customer_ml(seg, num_trees=3, max_depth=2, cross_validate=False)
    assert res.churn.model is None and res.upgrade.model is None
    assert M.top_winback(res.scored).count() == 0
    assert M.score_scatter(res.scored).count() == 0

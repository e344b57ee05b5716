"""Registered ML queries (M1-M8, T2, T3, F13).

Features and labels have DuckDB oracles; model outputs (scores, AUC,
importances, reports) cannot equal another library's forest numerically and
are checked by properties in the tests instead (rows-only here).
"""

from __future__ import annotations


from basketry.operators import ml as M
from basketry.plans.registry import register
from basketry.session import app_id
from basketry.sources.adapters import landed_segments, star_state

QUERY_TREES = 300
QUERY_DEPTH = M.MAX_DEPTH
REPORT_TREES = 100

_FEAT_SQL = """
SELECT customerId, segment, totalOrders, totalSales,
       CASE WHEN days_since_last_order = 0 THEN 999.0 ELSE days_since_last_order END
           AS days_since_last_order,
       customer_age_days,
       totalSales / greatest(totalOrders, 1.0) AS avg_order_value,
       totalOrders / greatest(customer_age_days / 30.0, 1.0) AS orders_per_month,
       (CASE WHEN days_since_last_order = 0 THEN 999.0 ELSE days_since_last_order END)
           / greatest(customer_age_days, 1.0) AS recency_age_ratio
FROM (SELECT customerId, segment, CAST(totalOrders AS DOUBLE) AS totalOrders,
             CAST(totalSales AS DOUBLE) AS totalSales,
             coalesce(CAST(days_since_last_order AS DOUBLE), 0.0) AS days_since_last_order,
             coalesce(CAST(customer_age_days AS DOUBLE), 0.0) AS customer_age_days
      FROM cust_seg)
"""
_FEATS = "customerId, segment, " + ", ".join(M.ML_FEATURES)


def _feat(spark, sf):
    return M.customer_features(landed_segments(spark, sf)).select(
        "customerId", "segment", *M.ML_FEATURES)


_TRAINED: dict[tuple, M.MlResult] = {}


def _ml(spark, sf):
    """One training run per application and input, shared by the ML keys."""
    key = app_id(spark), sf, star_state(spark, sf)
    if key not in _TRAINED:
        _TRAINED.clear()                 # models of a stopped session or of former input
        _TRAINED[key] = M.run_customer_ml(landed_segments(spark, sf), num_trees=QUERY_TREES, max_depth=QUERY_DEPTH)
    return _TRAINED[key]


@register("customer_features", f"SELECT {_FEATS} FROM ({_FEAT_SQL})")
def q_customer_features(spark, sf):
    return _feat(spark, sf)


@register("churn_labels", f"""
SELECT {_FEATS}, CAST(segment IN ('Lost', 'At-Risk') AS INTEGER) AS label
FROM ({_FEAT_SQL}) WHERE segment IN ('Champions', 'Loyal', 'Regular', 'Lost', 'At-Risk')
""")
def q_churn_labels(spark, sf):
    return M.churn_labels(_feat(spark, sf))


@register("upgrade_labels", f"""
SELECT {_FEATS}, CAST(segment IN ('Champions', 'Loyal') AS INTEGER) AS label
FROM ({_FEAT_SQL}) WHERE segment IN ('Champions', 'Loyal', 'Regular', 'Occasional')
""")
def q_upgrade_labels(spark, sf):
    return M.upgrade_labels(_feat(spark, sf))


@register("churn_score")
def q_churn_score(spark, sf):
    return _ml(spark, sf).scored.select("customerId", "segment", "churn_risk_score")


@register("upgrade_score")
def q_upgrade_score(spark, sf):
    return _ml(spark, sf).scored.select("customerId", "segment", "upgrade_potential_score")


@register("model_auc")
def q_model_auc(spark, sf):
    return M.model_auc_frame(spark, _ml(spark, sf))


_UNPIVOT = " UNION ALL ".join(f"SELECT model, label, '{f}' AS feature, {f} AS value FROM l" for f in M.ML_FEATURES)


@register("feature_auc", f"""
WITH f AS ({_FEAT_SQL}),
l AS (
  SELECT 'churn' AS model, CAST(segment IN ('Lost', 'At-Risk') AS INTEGER) AS label, * FROM f
  WHERE segment IN ('Champions', 'Loyal', 'Regular', 'Lost', 'At-Risk')
  UNION ALL
  SELECT 'upgrade', CAST(segment IN ('Champions', 'Loyal') AS INTEGER), * FROM f
  WHERE segment IN ('Champions', 'Loyal', 'Regular', 'Occasional')),
u AS ({_UNPIVOT}),
r AS (
  SELECT *, rank() OVER (PARTITION BY model, feature ORDER BY value)
            + (count(*) OVER (PARTITION BY model, feature, value) - 1) / 2.0 AS mean_rank
  FROM u WHERE value IS NOT NULL),
s AS (
  SELECT model, feature, sum(CASE WHEN label = 1 THEN mean_rank END) AS ranks,
         CAST(sum(label) AS BIGINT) AS p, CAST(sum(1 - label) AS BIGINT) AS n
  FROM r GROUP BY model, feature)
SELECT model, feature, CASE WHEN p > 0 AND n > 0 THEN (ranks - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n) END AS roc_auc,
       n AS n_negative, p AS n_positive
FROM s
""")
def q_feature_auc(spark, sf):
    """How well each feature alone ranks the labelled customers: the exact area under its ROC curve."""
    feat = _feat(spark, sf)
    return M.feature_auc({"churn": M.churn_labels(feat), "upgrade": M.upgrade_labels(feat)})


@register("feature_importances")
def q_feature_importances(spark, sf):
    return M.importances_frame(spark, _ml(spark, sf))


@register("top_winback")
def q_top_winback(spark, sf):
    return M.top_winback(_ml(spark, sf).scored)


@register("top_upsell")
def q_top_upsell(spark, sf):
    return M.top_upsell(_ml(spark, sf).scored)


@register("score_scatter")
def q_score_scatter(spark, sf):
    return M.score_scatter(_ml(spark, sf).scored)


@register("classification_report")
def q_classification_report(spark, sf):
    """Segment predicted from the customer features (80/20 hashed split)."""
    feat = _feat(spark, sf)
    return M.classification_report(feat, "segment", M.ML_FEATURES, key="customerId",
                                   num_trees=REPORT_TREES, max_depth=QUERY_DEPTH)

"""Plan-level properties of every registered query (explain, no execution checks)."""

import contextlib
import io

import pytest

from basketry.plans.registry import queries

ML_KEYS = {"churn_score", "upgrade_score", "model_auc", "feature_importances", "top_winback",
           "top_upsell", "score_scatter", "classification_report"}
# top-k inside salted slices; ranks inside range partitions
WINDOW_KEYS = {"top5_products", "product_trends_top5", "feature_auc"}
PUSHDOWN_KEYS = {"status_filter", "rolling_date_window", "orders_source", "customers_source",
                 "default_product_filter"}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(set(queries()) - ML_KEYS))
def test_plan_shape(spark, sf_dir, key):
    text = _plan(queries()[key](spark, sf_dir))
    tree = text.split("\n\n")[0]
    assert "CartesianProduct" not in tree and "BroadcastNestedLoopJoin" not in tree
    if key not in WINDOW_KEYS:
        assert " Window " not in tree and "Window (" not in tree
    if key in PUSHDOWN_KEYS:
        assert any(line.startswith("PushedFilters: [") and line.strip() != "PushedFilters: []"
                   for line in text.splitlines())

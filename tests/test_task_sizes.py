"""What a task holds must not grow with the input."""

import contextlib
import datetime as dt
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry import session as S
from basketry.operators import ml as M
from basketry.operators import products as P
from basketry.operators.forests import Forest
from basketry.sources import adapters as A


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().split("\n\n")[0]


@pytest.fixture
def settings(spark):
    keys = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k) for k in keys}
    yield spark.conf
    for k, v in before.items():
        spark.conf.set(k, v)


def test_partitions_follow_the_input(spark, settings):
    settings.set("spark.sql.shuffle.partitions", "8")
    settings.set("spark.sql.files.maxPartitionBytes", "128MB")
    S.size_tasks(spark, 1000)
    assert settings.get("spark.sql.shuffle.partitions") == "8"
    assert S._bytes(settings.get("spark.sql.files.maxPartitionBytes")) == S.SCAN_BYTES
    S.size_tasks(spark, 100 * S.SHUFFLE_BYTES + 1)
    assert settings.get("spark.sql.shuffle.partitions") == "101"
    S.size_tasks(spark, 1000)
    settings.set("spark.sql.files.maxPartitionBytes", "1m")
    S.size_tasks(spark, 0)
    assert settings.get("spark.sql.shuffle.partitions") == "101"
    assert settings.get("spark.sql.files.maxPartitionBytes") == "1m"


@pytest.mark.parametrize("text, size", [("16m", 16 << 20), ("128MB", 128 << 20), ("7", 7), ("1048576b", 1 << 20), ("2 GiB", 2 << 30)])
def test_sizes_in_settings(text, size):
    assert S._bytes(text) == size


def test_suppliers_are_not_joined_by_a_shuffle(spark, settings, sf_dir):
    settings.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for build in (A.order_items, A.availability):
        assert plan(build(spark, sf_dir)).count("BroadcastHashJoin") == 1


def test_landed_rows_are_built_once(spark, sf_dir):
    """Ranges over the whole table would build the rows a second time to find their bounds."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def count(x):
        seen.add(1)
        return x

    rows = [(x % 7, x) for x in range(200)]
    name = "test-built-once"
    got = A.landed(spark, name, sf_dir, lambda s, d: s.createDataFrame(rows, "k long, x long").repartition(4, "x")
                   .withColumn("x", count.asNondeterministic()("x")), cluster_by=["k", "x"])
    assert sorted(map(tuple, got.collect())) == sorted(rows) and seen.value == len(rows)


def test_producer_trends_by_one_shuffle(spark):
    d = dt.date(2024, 1, 1)
    rows = [(d, "a", 1.0, 1, "x"), (d, "a", 1.0, 1, "x"), (d, "a", None, 2, "x"), (d, "a", 2.0, None, None),
            (d, "b", None, None, None), (d, "b", None, 3, "y"), (None, "a", 1.0, 1, "x"), (d, None, 1.0, 1, "x")]
    df = spark.createDataFrame(rows, "periodStart date, producerName string, qty double, orderId long, productName string")
    out = P.producer_trends(df)
    assert plan(out).count(" Exchange") == 1
    assert sorted(map(tuple, out.collect())) == [(d, "a", 4.0, 2, 1), (d, "b", 0.0, 1, 1)]


def test_a_filter_on_scores_does_not_score_twice(spark):
    one = Forest(np.zeros(3, int), np.array([1.0, np.inf, np.inf]), np.array([[1, 2], [1, 1], [2, 2]]),
                 np.array([[.5, .5], [1., 0.], [.25, .75]]), np.array([0]), np.zeros(3), 1)
    model = M.TrainedModel(one, None, None)
    feat = spark.createDataFrame([(k, "Regular", *[float(k)] * 7) for k in range(3)],
                                 "customerId long, segment string, " + ", ".join(f"{c} double" for c in M.ML_FEATURES))
    scored = M.score(feat, {"churn_risk_score": model, "upgrade_potential_score": model})
    for out in (M.top_winback(scored), M.top_upsell(scored), M.score_scatter(scored)):
        assert plan(out).count("ArrowEvalPython") == 1
        assert {r.customerId: (r.churn_risk_score, r.upgrade_potential_score) for r in out.collect()} == \
            {0: (0.0, 0.0), 1: (0.0, 0.0), 2: (75.0, 75.0)}

"""Bounded forests and the exact area under the ROC curve."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from basketry.functions.auc import exact_auc
from basketry.operators import forests
from basketry.operators import ml as M
from basketry.operators import trees
from basketry.operators.forests import ForestConfig
from basketry.session import scratch_path


def area(rows):
    """Share of (positive, negative) pairs in order, ties half, pair by pair."""
    pos = [s for y, s in rows if y == 1 and s is not None]
    neg = [s for y, s in rows if y == 0 and s is not None]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_equals_counting_pairs(spark):
    rng = random.Random(3)
    groups = {
        "ties": [(rng.random() < 0.3, float(rng.randrange(6))) for _ in range(400)],
        "distinct": [(rng.random() < 0.5, rng.random()) for _ in range(400)],
        "one class": [(True, 1.0), (True, 2.0)],
        "all equal": [(True, 0.5), (False, 0.5), (False, 0.5)],
        "nulls": [(True, None), (None, 0.3), (True, 0.1), (False, 0.2), (False, float("inf")), (True, -0.0), (False, 0.0)],
        None: [(True, 3.0), (False, 1.0)],
    }
    rows = [(g, None if y is None else int(y), s) for g, v in groups.items() for y, s in v]
    df = spark.createDataFrame(rows, "g string, label int, score double").repartition(7)
    got = {r["g"]: r for r in exact_auc(df, "label", "score", ["g"]).collect()}
    for g, v in groups.items():
        want = area([(y, s) for y, s in v if y is not None])
        assert got[g]["roc_auc"] == (None if want is None else pytest.approx(want, abs=1e-12)), g
    assert got["ties"]["n_positive"] + got["ties"]["n_negative"] == 400


def test_auc_of_many_partitions_and_of_nothing(spark):
    df = spark.range(20_000).select((F.xxhash64("id") % 7 == 0).cast("int").alias("label"),
                                    (F.xxhash64("id", F.lit(1)) % 5000).cast("double").alias("score"))
    rows = [(r["label"], r["score"]) for r in df.collect()]
    order = np.sort(np.array([s for y, s in rows if y == 0]))
    pos = np.array([s for y, s in rows if y == 1])
    want = (np.searchsorted(order, pos, "left") + np.searchsorted(order, pos, "right")).sum() / 2 / len(pos) / len(order)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert exact_auc(df, "label", "score", []).first()["roc_auc"] == pytest.approx(want, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert exact_auc(df.where("false").withColumn("g", F.lit(1)), "label", "score", ["g"]).collect() == []


def points(spark, n=600, classes=2):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = np.clip(np.floor(x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.3 + classes / 2), 0, classes - 1).astype(int)
    rows = [(int(k), int(c), *map(float, r)) for k, (c, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, label int, f0 double, f1 double, f2 double")


@pytest.mark.parametrize("classes", [2, 4])
def test_node_table_scores_like_the_fitted_model(spark, classes):
    names = ["f0", "f1", "f2"]
    df = VectorAssembler(inputCols=names, outputCol="features").transform(points(spark, classes=classes))
    model = RandomForestClassifier(numTrees=17, maxDepth=8, seed=5, maxBins=64).fit(df)
    path = scratch_path(spark, "model")
    model.write().save(path)
    forest = forests.load_forest(spark, [path], classes)
    assert len(forest.roots) == 17
    both = model.transform(df).withColumn("p", forests.probabilities(spark, [forest], names)).select("probability", "p").collect()
    assert np.allclose([r["probability"].toArray() for r in both], [r["p"] for r in both])
    assert forest.importances(3) == pytest.approx(list(model.featureImportances.toArray()))


def test_samples_are_bounded_stratified_and_differ(spark):
    data = spark.range(10_000).select((F.col("id") % 10 == 0).cast("int").alias("label"), (F.floor(F.col("id") / 10)).alias("_index"))
    data = data.withColumn("_index", F.when(F.col("label") == 1, F.col("_index"))
                           .otherwise(F.col("_index") * 9 + F.lit(0))).dropDuplicates(["label", "_index"])
    sizes = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    config = ForestConfig(rows=200)
    seen = []
    for group in range(4):
        rows = forests.sample_rows(data, sizes, config, group).collect()
        assert len(rows) <= 202
        seen.append({(r["label"], r["_index"]) for r in rows})
    assert not seen[0] & seen[1]
    everything = forests.sample_rows(data, sizes, ForestConfig(rows=10**9), 3)
    assert everything.count() == sum(sizes.values())


def test_size_of_a_forest_does_not_follow_the_table(spark):
    small, large = (points(spark, n).withColumn("_index", F.col("id")).withColumn("label", F.lit(0)).withColumn(
        "label", (F.col("f0") > 0).cast("int")) for n in (400, 4000))
    config = ForestConfig(num_trees=6, group_trees=3, rows=300)
    nodes = []
    for df in (small, large):
        df = M.stratified_number(df.drop("_index"), "label", [F.col("id")], 1).withColumnRenamed("_number", "_index")
        sizes = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
        forest = forests.fit_groups(spark, {0: (df, sizes)}, ["f0", "f1", "f2"], config, weighted=False)[0]
        assert len(forest.roots) == 6 and len(forest.feature) <= 6 * 2 * 300
        nodes.append(len(forest.feature))
    assert nodes[1] < 3 * nodes[0]


def test_index_outside_a_fold_counts_from_zero(spark):
    df = spark.range(53).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    data = M.stratified_number(df, "label", [F.col("id")], 9)
    counts = M.class_counts(df)
    for fold in (None, 0, 1, 4):
        rows, sizes = M._training_rows(M._Prepared(data, counts, 5), fold)
        for label in (0, 1):
            got = sorted(r["_index"] for r in rows.where(F.col("label") == label).collect())
            assert got == list(range(sizes[label]))


def test_forests_see_every_row(spark):
    """Stripes of three neighbouring values: a sample of some thousand rows, or a few hundred thresholds, can't tell them apart."""
    n = 9000
    df = spark.range(n).select("id", (F.floor(F.col("id") / 3) % 2).cast("int").alias("label"), F.col("id").cast("double").alias("f0"))
    data = M.stratified_number(df, "label", [F.col("id")], 1).withColumnRenamed("_number", "_index")
    config = ForestConfig(num_trees=25, group_trees=10)
    forest = forests.fit_groups(spark, {0: (data, {0: n // 2, 1: n // 2})}, ["f0"], config, weighted=True)[0]
    assert len(forest.roots) == 25
    right = df.withColumn("p", forests.probabilities(spark, [forest], ["f0"])[1]).where((F.col("p") > 0.5) == (F.col("label") == 1))
    assert right.count() > 0.85 * n
    again = forests.fit_groups(spark, {0: (data.repartition(5, "f0"), {0: n // 2, 1: n // 2})}, ["f0"], config, weighted=True)[0]
    assert np.array_equal(again.threshold, forest.threshold) and np.array_equal(again.votes, forest.votes)


def best_by_hand(x, y, weight, class_weight):
    """Largest decrease of the Gini impurity over all features and thresholds."""
    def squares(some):
        mass = np.array([weight[some & (y == c)].sum() * w for c, w in enumerate(class_weight)])
        return (mass ** 2).sum() / mass.sum()
    every = np.ones(len(y), bool)
    scores = [squares(f <= t) + squares(f > t) for f in x for t in np.unique(f)[:-1]]
    mass = sum(weight[y == c].sum() * w for c, w in enumerate(class_weight))
    return (max(scores) - squares(every)) / mass if scores else None


@pytest.mark.parametrize("classes", [2, 3])
def test_nodes_split_at_the_best_of_all_thresholds(classes):
    rng = np.random.default_rng(classes)
    n = 150
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.full(n, 7.0)])
    x[0, :3], x[0, 3:6] = [-0.0, 0.0, 1e300], [np.inf, -np.inf, -1e300]
    y = rng.integers(0, classes, n).astype(np.uint8)
    class_weight = np.arange(1.0, classes + 1)
    nodes = trees.grow(np.stack([trees.codes(v) for v in x]), y, class_weight, [4, 9], 5, 30, 3)
    with np.errstate(over="ignore"):
        x = x.astype(np.float32).astype(float)
    assert sorted(set(nodes.tree)) == [4, 9]
    for number in (4, 9):
        own = np.flatnonzero(nodes.tree == number)
        weight = np.bincount(np.random.default_rng([5, number]).integers(0, n, n), minlength=n)
        inside = {0: weight > 0}
        for k, node in enumerate(own):
            rows = inside[k]
            assert nodes.stats[node].tolist() == [weight[rows & (y == c)].sum() * w for c, w in enumerate(class_weight)]
            best = best_by_hand(x[:, rows], y[rows], weight[rows], class_weight)
            if nodes.left[node] < 0:
                assert best is None or np.count_nonzero(nodes.stats[node]) == 1
                continue
            assert nodes.gain[node] == pytest.approx(best)
            high = x[nodes.feature[node]] > nodes.threshold[node]
            inside[nodes.left[node]], inside[nodes.right[node]] = rows & ~high, rows & high
        assert len(inside) == len(own)


def test_trees_stop_at_their_depth_and_reject_missing_values():
    x = np.arange(64.0)
    y = (np.arange(64) % 2).astype(np.uint8)
    nodes = trees.grow(trees.codes(x)[None], y, np.ones(2), [0], 1, 3, 1)
    assert len(nodes.tree) <= 2 ** 4 - 1
    with pytest.raises(ValueError):
        trees.codes(np.array([1.0, np.nan]))

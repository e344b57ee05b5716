"""Random forests on all labelled rows, kept as node tables.

Every tree draws from all rows of its fit and may split at every threshold
(``trees``). Trees are dealt to tasks: a task reads the rows of its fit as 32-bit
codes, 4 bytes a feature and one for the class, and grows ``group_trees``
trees on them, so more executors shorten training, and neither rows nor
statistics pass the driver, which gets the nodes alone. ``ForestConfig.rows`` can
bound the rows of a group of trees by a sample; no registered query sets it.
Scoring walks the node table in Arrow batches, next to the rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import trees

SCORED_ROWS = 1_000       # rows that walk the trees at a time
GROWN_ROWS = 500_000      # rows of all trees that grow side by side, unless one tree has more
MAX_DEPTH = 30            # the trees are meant to be unlimited


@dataclass(frozen=True)
class ForestConfig:
    num_trees: int = 300
    max_depth: int = MAX_DEPTH
    seed: int = 42
    group_trees: int = 30      # trees that one task grows
    rows: int | None = None    # labelled rows of a group, at most; None: all of them


@dataclass
class Forest:
    """Nodes of all trees in one numbering; a leaf is its own child. ``votes`` is a leaf's share of each class."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray          # (nodes, 2): at most the threshold, above it
    votes: np.ndarray          # (nodes, classes)
    roots: np.ndarray
    gain: np.ndarray           # impurity decrease times the weight of the node's rows, 0 for leaves
    depth: int

    def for_scoring(self) -> Forest:
        """The same trees with node numbers of 32 bits and without gains: what a worker holds to score rows."""
        return replace(self, feature=self.feature.astype(np.int32), child=self.child.astype(np.int32),
                       roots=self.roots.astype(np.int32), gain=self.gain[:0])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes): the trees' votes on average."""
        out = np.zeros((len(x), self.votes.shape[1]))
        rows = np.arange(len(x))
        for first in range(0, len(self.roots), 50):
            roots = self.roots[first:first + 50]
            at = np.repeat(roots[:, None], len(x), axis=1)
            for _ in range(self.depth):
                above = x[rows, self.feature[at]] > self.threshold[at]
                at = self.child[at, above.astype(np.int8)]
            out += self.votes[at].sum(axis=0)
        return out / len(self.roots)

    def importances(self, n_features: int) -> list[float]:
        """Share of each feature in the impurity decrease: per tree, then over the trees."""
        total = np.zeros(n_features)
        ends = np.append(self.roots[1:], len(self.feature))
        for a, b in zip(self.roots, ends):
            one = np.bincount(self.feature[a:b], self.gain[a:b], n_features)
            if one.sum() > 0:
                total += one / one.sum()
        return (total / total.sum()).tolist() if total.sum() > 0 else total.tolist()


def sample_rows(data: DataFrame, sizes: dict[int, int], config: ForestConfig, group: int) -> DataFrame:
    """At most ``config.rows`` rows (and one a class more), for a caller that sets them: each class by its share, in the order of ``_index``.

    ``_index`` numbers each class's rows 0, 1, ...; groups take consecutive
    stretches, starting again where a class ends.
    """
    n = sum(sizes.values())
    chosen = F.lit(False)
    for label, size in sizes.items():
        take = min(size, -(-config.rows * size // n))
        inside = F.pmod(F.col("_index") - F.lit(group * take), F.lit(size)) < take
        chosen = chosen | ((F.col("label") == label) & inside)
    return data.where(chosen)


_GROWN = ("tree int, feature int, threshold double, left int, right int, gain double, stats array<double>")


def _grower(features: list[str], classes: list[int], weighted: bool, numbers: list[int], config: ForestConfig):
    """Grows the trees ``numbers`` from all Arrow batches of a task."""
    def grow(batches):
        code, label, index = [], [], []
        for b in batches:
            if b.num_rows:
                code.append(np.stack([trees.codes(b.column(f).to_numpy(zero_copy_only=False)) for f in features]))
                label.append(np.searchsorted(classes, b.column("label").to_numpy(zero_copy_only=False)).astype(np.uint8))
                index.append(b.column("_index").to_numpy(zero_copy_only=False))
        if not label:
            return
        label = np.concatenate(label)
        order = np.lexsort((np.concatenate(index), label))         # the same trees however the rows are dealt out
        label = label[order]
        code[:] = [np.concatenate(code, axis=1)]
        for f in range(len(features)):
            code[0][f] = code[0][f][order]
        code = code[0]
        index = order = None
        n = np.bincount(label, minlength=len(classes))
        class_weight = len(label) / (len(classes) * np.maximum(n, 1.0)) if weighted else np.ones(len(classes))
        step = max(1, GROWN_ROWS // len(label))
        for first in range(0, len(numbers), step):
            t = trees.grow(code, label, class_weight, numbers[first:first + step], config.seed, config.max_depth,
                           int(np.ceil(np.sqrt(len(features)))))
            ends = np.arange(0, t.stats.size + 1, len(classes), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.tree, pa.int32()), pa.array(t.feature, pa.int32()), pa.array(t.threshold),
                 pa.array(t.left, pa.int32()), pa.array(t.right, pa.int32()), pa.array(t.gain),
                 pa.ListArray.from_arrays(ends, t.stats.reshape(-1))],
                ["tree", "feature", "threshold", "left", "right", "gain", "stats"])
    return grow


def fit_groups(spark: SparkSession, jobs: dict[object, tuple[DataFrame, dict[int, int]]], features: list[str],
               config: ForestConfig, weighted: bool) -> dict[object, Forest]:
    """Fit the forests of all jobs (rows with label and ``_index``; rows a class) side by side.

    ``weighted``: every class weighs as much as any other.
    """
    groups = [range(k, min(k + config.group_trees, config.num_trees))
              for k in range(0, config.num_trees, config.group_trees)]

    def fit(data: DataFrame, sizes: dict[int, int], group: int) -> pa.Table:
        rows = data if config.rows is None else sample_rows(data, sizes, config, group)
        rows = rows.select(F.col("label").cast("int").alias("label"), "_index",
                           *[F.col(c).cast("double").alias(c) for c in features]).coalesce(1)
        return rows.mapInArrow(_grower(features, sorted(sizes), weighted, list(groups[group]), config), _GROWN).toArrow()

    with ThreadPoolExecutor(max_workers=max(1, spark.sparkContext.defaultParallelism)) as pool:
        found = {key: [pool.submit(fit, data, sizes, g) for g in range(len(groups))]
                 for key, (data, sizes) in jobs.items()}
        return {key: _grown(pa.concat_tables([p.result() for p in parts]), len(jobs[key][1])) for key, parts in found.items()}


def _grown(table: pa.Table, classes: int) -> Forest:
    stats = table["stats"].combine_chunks().flatten().to_numpy().reshape(-1, classes)
    t = table.drop_columns(["stats"]).to_pandas()
    return _forest(t, np.flatnonzero(t["tree"].diff().ne(0)), stats, classes)


def load_forest(spark: SparkSession, paths: list[str], classes: int) -> Forest:
    """Read forests that MLlib has saved as one node table."""
    n = F.col("nodeData")
    table = None
    for k, path in enumerate(paths):
        part = spark.read.parquet(f"{path}/data").select(
            F.lit(k).alias("model"), F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"),
            n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
            F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"), n["gain"].alias("gain"),
            n["impurityStats"].alias("stats"))
        table = part if table is None else table.union(part)
    t = table.toArrow().to_pandas().sort_values(["model", "tree", "id"], ignore_index=True)
    stats = np.zeros((len(t), classes))
    for k, s in enumerate(t["stats"]):
        stats[k, :len(s)] = s
    return _forest(t, np.flatnonzero(t["id"] == 0), stats, classes)


def _forest(t: pd.DataFrame, roots: np.ndarray, stats: np.ndarray, classes: int) -> Forest:
    """Nodes of trees one after the other, which are numbered 0, 1, ... inside a tree, as one table."""
    base = np.repeat(roots, np.diff(np.append(roots, len(t))))
    leaf = (t["left"] < 0).to_numpy()
    own = np.arange(len(t))
    child = np.stack([np.where(leaf, own, base + t["left"]), np.where(leaf, own, base + t["right"])], axis=1)
    stats = np.pad(stats, ((0, 0), (0, max(0, 2 - classes))))
    weight = stats.sum(axis=1)
    votes = stats / np.where(weight > 0, weight, 1.0)[:, None]
    depth, level = 0, roots
    while len(level := np.unique(child[level][~leaf[level]])):
        depth += 1
    return Forest(np.where(leaf, 0, t["feature"]), np.where(leaf, np.inf, t["threshold"].astype(float)), child, votes, roots,
                  np.where(leaf, 0.0, t["gain"] * weight), depth)


def probabilities(spark: SparkSession, forests: list[Forest], features: list[str], which: Column | None = None) -> Column:
    """Class probabilities of each row by ``forests[which]`` (the first, if none is named), as an array.

    Declared not deterministic, though it is: Spark would else evaluate it once
    below a filter on the result and once more above it, in twice as many
    Python workers, each with its own copy of the forests.
    """
    shared = spark.sparkContext.broadcast([f.for_scoring() for f in forests])

    # not an iterator: Spark runs several plain functions in one worker, iterators in one each
    @F.pandas_udf("array<double>")
    def walk(k: pd.Series, *cols: pd.Series) -> pd.Series:
        own = shared.value
        with np.errstate(over="ignore"):
            x = np.stack([c.to_numpy(dtype=float) for c in cols], axis=1).astype(np.float32)     # as the trees count them
        out = np.empty((len(x), own[0].votes.shape[1]))
        k = k.to_numpy()
        for forest in np.unique(k):
            at = np.flatnonzero(k == forest)
            for first in range(0, len(at), SCORED_ROWS):
                some = at[first:first + SCORED_ROWS]
                out[some] = own[forest].probabilities(x[some])
        return pd.Series(list(out))

    walk = walk.asNondeterministic()
    return walk(F.lit(0) if which is None else which.cast("int"), *[F.col(c).cast("double") for c in features])

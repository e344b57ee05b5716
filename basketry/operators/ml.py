"""Churn-risk and upgrade-potential scoring with distributed random forests.

Features and labels are DataFrame expressions. Forests are fitted on all
labelled rows and kept as node tables (``forests``);
cross-validation scores every labelled row by the forest that has not seen its
fold, and the area under the ROC curve is exact (``exact_auc``). Only class
counts, node tables and one figure a fold reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.auc import exact_auc
from basketry.functions.cleaning import to_number
from basketry.operators.forests import MAX_DEPTH, Forest, ForestConfig, fit_groups, probabilities
from basketry.session import ensure_checkpoint_dir

# Model features in order, and their display labels.
ML_FEATURES = [
    "totalOrders",
    "totalSales",
    "days_since_last_order",
    "customer_age_days",
    "avg_order_value",
    "orders_per_month",
    "recency_age_ratio",
]
FEATURE_LABELS = {
    "totalOrders":           "Total Orders",
    "totalSales":            "Lifetime Sales ($)",
    "days_since_last_order": "Days Since Last Order",
    "customer_age_days":     "Customer Age (days)",
    "avg_order_value":       "Avg Order Value ($)",
    "orders_per_month":      "Orders / Month",
    "recency_age_ratio":     "Recency / Age Ratio",
}
CHURN_SEGMENTS = ["Champions", "Loyal", "Regular", "Lost", "At-Risk"]
CHURN_POSITIVE = ["Lost", "At-Risk"]
UPGRADE_SEGMENTS = ["Champions", "Loyal", "Regular", "Occasional"]
UPGRADE_POSITIVE = ["Champions", "Loyal"]
MIN_PER_CLASS = 10
MAX_FOLDS = 5
DAYS_PER_MONTH_ML = 30


def customer_features(seg: DataFrame) -> DataFrame:
    """Seven numeric features; missing values 0, then recency 0 -> 999."""
    df = seg.withColumns({c: to_number(c) if c in seg.columns else F.lit(0.0)
                          for c in ML_FEATURES[:4]})
    df = df.withColumn("days_since_last_order",
                       F.when(F.col("days_since_last_order") == 0, F.lit(999.0))
                       .otherwise(F.col("days_since_last_order")))
    return df.withColumns({
        "avg_order_value": F.col("totalSales") / F.greatest(F.col("totalOrders"), F.lit(1.0)),
        "orders_per_month": F.col("totalOrders")
        / F.greatest(F.col("customer_age_days") / F.lit(float(DAYS_PER_MONTH_ML)), F.lit(1.0)),
        "recency_age_ratio": F.col("days_since_last_order")
        / F.greatest(F.col("customer_age_days"), F.lit(1.0)),
    })


def _labels(feat: DataFrame, segments: list[str], positive: list[str]) -> DataFrame:
    return feat.where(F.col("segment").isin(segments)).withColumn(
        "label", F.col("segment").isin(positive).cast("int"))


def churn_labels(feat: DataFrame) -> DataFrame:
    """Clear outcomes only; 1 = Lost or At-Risk, 0 = Champions / Loyal / Regular."""
    return _labels(feat, CHURN_SEGMENTS, CHURN_POSITIVE)


def upgrade_labels(feat: DataFrame) -> DataFrame:
    """Mid-tier customers; 1 = Champions or Loyal, 0 = Regular / Occasional."""
    return _labels(feat, UPGRADE_SEGMENTS, UPGRADE_POSITIVE)


def class_counts(labeled: DataFrame) -> dict[int, int]:
    return {r["label"]: r["n"] for r in
            labeled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


@dataclass
class TrainedModel:
    model: Forest | None
    auc: float | None
    importances: list[float] | None
    counts: dict[int, int] = field(default_factory=dict)


@dataclass
class _Prepared:
    data: DataFrame | None
    counts: dict[int, int]
    folds: int


SLICES = 256              # hash slices a class is numbered in


def stratified_number(df: DataFrame, label: str, keys: list[Column], seed: int) -> DataFrame:
    """Add ``_number``: 0, 1, ... within each class, in the order of a seeded hash.

    Rows are numbered inside (class, hash slice) and shifted by the sizes of
    the class's earlier slices, so no task sorts a whole class. Taking the
    number modulo k deals each class evenly to k folds.
    """
    h = F.xxhash64(*keys, F.lit(seed))
    rows = df.withColumn("_hash", h).withColumn("_slice", F.pmod("_hash", F.lit(SLICES)))
    sizes = rows.groupBy(label, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col(label).alias("_of"), F.col("_slice").alias("_at"),
                         F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(label, "_slice").orderBy("_hash", *keys)
    return (rows.withColumn("_in", F.row_number().over(inside) - 1)
            .join(shift, F.col(label).eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_at")))
            .withColumn("_number", F.col("_shift") + F.col("_in"))
            .drop("_hash", "_slice", "_in", "_of", "_at", "_shift"))


def _prepare(labeled: DataFrame, key: str, seed: int) -> _Prepared:
    """Class counts and the labelled rows, numbered in each class, as a table in the shared folder."""
    counts = class_counts(labeled)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if n0 < MIN_PER_CLASS or n1 < MIN_PER_CLASS:
        return _Prepared(None, counts, 0)
    ensure_checkpoint_dir(labeled.sparkSession)
    data = stratified_number(labeled.select(key, "label", *ML_FEATURES), "label", [F.col(key)], seed)
    return _Prepared(data.checkpoint(eager=True), counts, min(MAX_FOLDS, n0, n1))


def _training_rows(p: _Prepared, fold: int | None) -> tuple[DataFrame, dict[int, int]]:
    """The rows to train on, without a fold, with their ``_index`` in the class, and their number by class.

    A row's fold is its number modulo the number of folds, so its index among
    the rows outside a fold follows from its number alone.
    """
    number, k = F.col("_number"), p.folds
    if fold is None:
        sizes, rows, index = p.counts, p.data, number
    else:
        sizes = {c: n - (n - fold + k - 1) // k for c, n in p.counts.items()}
        rows = p.data.where(number % k != fold)
        index = number - F.floor((number - fold + k - 1) / k)
    return rows.withColumn("_index", index.cast("long")), sizes


def _fit_all(prepared: list[_Prepared], config: ForestConfig, cross_validate: bool) -> list[TrainedModel]:
    """Fit every full model and every cross-validation fold side by side; score the folds in one pass a model."""
    jobs = {}
    for j, p in enumerate(prepared):
        if p.data is not None:
            for fold in [None, *range(p.folds if cross_validate else 0)]:
                jobs[j, fold] = _training_rows(p, fold)
    if not jobs:
        return [TrainedModel(None, None, None, p.counts) for p in prepared]
    spark = next(iter(jobs.values()))[0].sparkSession
    forests = fit_groups(spark, jobs, ML_FEATURES, config, weighted=True)
    out = []
    for j, p in enumerate(prepared):
        if p.data is None:
            out.append(TrainedModel(None, None, None, p.counts))
            continue
        auc = None
        if cross_validate:
            scored = out_of_fold(p, [forests[j, i] for i in range(p.folds)])
            areas = exact_auc(scored, "label", "score", ["fold"]).orderBy("fold").collect()     # one row a fold
            auc = sum(r["roc_auc"] for r in areas) / len(areas)
        model = forests[j, None]
        out.append(TrainedModel(model, auc, model.importances(len(ML_FEATURES)), p.counts))
    return out


def out_of_fold(p: _Prepared, forests: list[Forest]) -> DataFrame:
    """Every labelled row with its fold and P(class 1) by the forest that was fitted without that fold."""
    rows = p.data.withColumn("fold", (F.col("_number") % p.folds).cast("int"))
    p1 = probabilities(rows.sparkSession, forests, ML_FEATURES, F.col("fold"))[1]
    return rows.select("fold", "label", p1.alias("score"))


def train_binary(labeled: DataFrame, key: str = "customerId", num_trees: int = 300,
                 max_depth: int = MAX_DEPTH, seed: int = 42, cross_validate: bool = True) -> TrainedModel:
    """Balanced random forest; mean ROC-AUC over up to five folds.

    Trains only with at least ``MIN_PER_CLASS`` rows in each class. Class
    weights are ``n / (2 * n_class)`` of the rows of each fit. Every
    class is dealt evenly to the folds.
    """
    config = ForestConfig(num_trees=num_trees, max_depth=max_depth, seed=seed)
    return _fit_all([_prepare(labeled, key, seed)], config, cross_validate)[0]


def score(feat: DataFrame, models: dict[str, TrainedModel]) -> DataFrame:
    """A column for each model: P(class 1) x 100 rounded half-even to one decimal; null when untrained.

    All models score a row in one pass, so a task needs one Python worker.
    """
    def column(trained: TrainedModel) -> Column:
        if trained.model is None:
            return F.lit(None).cast("double")
        return F.bround(probabilities(feat.sparkSession, [trained.model], ML_FEATURES)[1] * 100.0, 1)

    return feat.withColumns({name: column(t) for name, t in models.items()})


@dataclass
class MlResult:
    scored: DataFrame
    churn: TrainedModel
    upgrade: TrainedModel


def run_customer_ml(seg: DataFrame, num_trees: int = 300, max_depth: int = MAX_DEPTH, seed: int = 42,
                    cross_validate: bool = True) -> MlResult:
    feat = customer_features(seg)
    prepared = [_prepare(churn_labels(feat), "customerId", seed),
                _prepare(upgrade_labels(feat), "customerId", seed)]
    config = ForestConfig(num_trees=num_trees, max_depth=max_depth, seed=seed)
    churn, upgrade = _fit_all(prepared, config, cross_validate)
    scored = score(feat, {"churn_risk_score": churn, "upgrade_potential_score": upgrade})
    return MlResult(scored, churn, upgrade)


def importances_frame(spark: SparkSession, res: MlResult) -> DataFrame:
    """Feature importance per model, with display labels (ascending per model)."""
    rows = []
    for name, t in (("churn", res.churn), ("upgrade", res.upgrade)):
        if t.importances is not None:
            rows += [(name, f, FEATURE_LABELS[f], float(v)) for f, v in zip(ML_FEATURES, t.importances)]
    return spark.createDataFrame(rows, "model string, feature string, feature_label string, "
                                       "importance double").orderBy("model", "importance")


def model_auc_frame(spark: SparkSession, res: MlResult) -> DataFrame:
    rows = [(name, t.auc, t.counts.get(0, 0), t.counts.get(1, 0), t.model is not None)
            for name, t in (("churn", res.churn), ("upgrade", res.upgrade))]
    return spark.createDataFrame(rows, "model string, roc_auc double, n_negative long, "
                                       "n_positive long, trained boolean")


def feature_auc(labeled: dict[str, DataFrame]) -> DataFrame:
    """model, feature, roc_auc, n_negative, n_positive: every feature taken as a score of its own."""
    rows = None
    for model, df in labeled.items():
        values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in ML_FEATURES])
        part = df.select(F.lit(model).alias("model"), "label", F.inline(values))
        rows = part if rows is None else rows.union(part)
    return exact_auc(rows, "label", "value", ["model", "feature"])


WINBACK_EXCLUDE = ["Lost", "Never Ordered"]
UPSELL_EXCLUDE = ["Champions", "Loyal", "Lost", "Never Ordered"]
TOP_COLUMNS = ["customerId", "fullName", "email", "custType", "segment", "churn_risk_score",
               "upgrade_potential_score", "totalOrders", "totalSales", "days_since_last_order"]


def _top(scored: DataFrame, exclude: list[str], col: str, n: int) -> DataFrame:
    cols = [c for c in TOP_COLUMNS if c in scored.columns]
    return (scored.where(~F.col("segment").isin(exclude) & F.col(col).isNotNull())
            .orderBy(F.desc(col), "customerId").limit(n).select(*cols))


def top_winback(scored: DataFrame, n: int = 20) -> DataFrame:
    return _top(scored, WINBACK_EXCLUDE, "churn_risk_score", n)


def top_upsell(scored: DataFrame, n: int = 20) -> DataFrame:
    return _top(scored, UPSELL_EXCLUDE, "upgrade_potential_score", n)


def score_scatter(scored: DataFrame) -> DataFrame:
    cols = [c for c in ["customerId", "fullName", "segment", "churn_risk_score",
                        "upgrade_potential_score", "totalSales", "totalOrders",
                        "days_since_last_order"] if c in scored.columns]
    return scored.where(F.col("churn_risk_score").isNotNull()
                        & F.col("upgrade_potential_score").isNotNull()).select(*cols)


# -- generic classification report ----------------------------------------------

def classification_report(df: DataFrame, target: str, features: list[str] | None = None,
                          key: str | None = None, test_fraction: float = 0.2, seed: int = 42,
                          num_trees: int = 100, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Train a forest on ~80 % of rows, report per-class precision / recall / F1 /
    support on the rest, plus accuracy and macro / weighted averages.

    The split is stratified: of each class every ``1 / test_fraction``-th row, in
    the order of a seeded hash of ``key`` (or of all feature values), is tested.
    Classes that are only predicted or only tested are listed with what they have.
    """
    features = features or [c for c in df.columns if c != target and c != key]
    hash_cols = [F.col(key)] if key else [F.col(c) for c in features]
    data = df.select(*([key] if key else []), target, *[F.col(c).cast("double").alias(c) for c in features]) \
        .dropna(subset=[target]).fillna(0.0, subset=features)
    step = max(2, round(1 / test_fraction))
    ensure_checkpoint_dir(df.sparkSession)
    data = (stratified_number(data, target, hash_cols, seed).withColumn("_test", F.col("_number") % step == step - 1)
            .withColumn("_index", F.col("_number") - F.floor((F.col("_number") + 1) / step)).checkpoint(eager=True))
    sizes = {r[target]: r["n"] for r in data.where(~F.col("_test")).groupBy(target)
             .agg(F.count(F.lit(1)).alias("n")).collect()}            # one row a class
    names = sorted(sizes, key=str)
    if not names:
        return report_from_counts(df.sparkSession.createDataFrame([], "actual string, predicted string, n long"))
    code = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(names) for x in (c, k)]), F.col(target))
    train = data.where(~F.col("_test")).withColumn("label", code.cast("int"))
    config = ForestConfig(num_trees=num_trees, max_depth=max_depth, seed=seed)
    forest = fit_groups(df.sparkSession, {0: (train, {k: sizes[c] for k, c in enumerate(names)})}, features, config,
                        weighted=False)[0]
    p = probabilities(df.sparkSession, [forest], features)
    tested = data.where("_test").withColumn("_p", p)
    predicted = F.get(F.array(*[F.lit(str(c)) for c in names]), F.array_position("_p", F.array_max("_p")).cast("int") - 1)
    cm = tested.groupBy(F.col(target).cast("string").alias("actual"), predicted.alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return report_from_counts(cm)


def report_from_counts(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support from (actual, predicted, n), with averages.

    A class that is never predicted has precision 0, one that never occurs
    recall 0; both count in the macro average.
    """
    hit = F.col("actual") == F.col("predicted")
    per_true = cm.groupBy(F.col("actual").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    per_pred = cm.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted"))
    per = (per_true.join(per_pred, "class", "full_outer")
           .select("class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "support", "predicted")]))
    per = per.select("class", "support",
                     F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted"))
                     .otherwise(0.0).alias("precision"),
                     F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
                     .otherwise(0.0).alias("recall"), "tp")
    per = per.withColumn("f1_score", F.when(F.col("precision") + F.col("recall") > 0,
                                            2 * F.col("precision") * F.col("recall")
                                            / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                  F.avg("f1_score").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"))
    def row(name, prec, rec, f1):
        return F.struct(F.lit(name).alias("class"), prec.alias("precision"), rec.alias("recall"),
                        f1.alias("f1_score"), F.col("n").alias("support"))
    acc = F.col("tp") / F.col("n")
    summary = tot.select(F.explode(F.array(
        row("accuracy", acc, acc, acc),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")))).alias("s"))
    summary = summary.select("s.*")
    return (per.select("class", "precision", "recall", "f1_score", F.col("support").cast("long"))
            .unionByName(summary.select("class", "precision", "recall", "f1_score",
                                        F.col("support").cast("long"))))

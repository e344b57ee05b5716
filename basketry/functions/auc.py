"""Exact area under the ROC curve, distributed: rank sums with tie blocks.

The area is the share of (positive, negative) pairs in which the positive has
the higher score, ties counting half. Equal scores are folded into one block
(map-side combined), blocks are range-partitioned by score, every partition
sums its own negatives, and the sums of the partitions before it shift its
ranks. No task sorts all scores and nothing is binned; only one number a
partition and group is ever brought together in a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir


def exact_auc(scored: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """One row per group: the ``by`` columns, roc_auc, n_negative, n_positive.

    ``label`` is 0 or 1; rows without label or score are left out, NaN ranks
    above every number. A group with one class only has no area (null).
    """
    groups = [f"_g{i}" for i in range(len(by))]
    blocks = (scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
              .groupBy(*[F.col(c).alias(g) for c, g in zip(by, groups)], F.col(score).cast("double").alias("_score"))
              .agg(F.sum((F.col(label) == 1).cast("long")).alias("_pos"),
                   F.sum((F.col(label) == 0).cast("long")).alias("_neg")))
    ensure_checkpoint_dir(scored.sparkSession)
    blocks = (blocks.repartitionByRange(*groups, "_score").withColumn("_part", F.spark_partition_id())
              .checkpoint(eager=True))
    parts = blocks.groupBy(*groups, "_part").agg(F.sum("_neg").alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(*[F.col(g).alias(f"{g}s") for g in groups], F.col("_part").alias("_at"),
                         F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*groups, "_part").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}s"))
    below = F.col("_shift") + F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    wins = F.col("_pos").cast("decimal(18,0)") * (2 * below + F.col("_neg")).cast("decimal(19,0)")
    total = (blocks.join(shift, same).withColumn("_wins", wins).groupBy(*groups)
             .agg(F.sum("_wins").alias("_wins"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")))
    pairs = 2.0 * F.col("_p") * F.col("_n")
    return total.select(*[F.col(g).alias(c) for g, c in zip(groups, by)],
                        F.when(pairs > 0, F.col("_wins").cast("double") / pairs).alias("roc_auc"),
                        F.col("_n").alias("n_negative"), F.col("_p").alias("n_positive"))

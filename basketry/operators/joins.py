"""Joins whose hot keys are split off explicitly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.01      # a key with more than this share of the rows is joined by replicated rows


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold more than ``share`` of the rows with a key: fewer than ``1 / share`` values.

    Counted with partial sums in each task, so a hot key is one row a task
    before the shuffle; the number of rows is the sum of the counts.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # the most frequent 1 / share keys hold every key above the share
    top = counts.orderBy(F.desc("n"), key).limit(int(1 / share))
    total = counts.agg(F.sum("n").alias("total"))
    rows = top.join(F.broadcast(total), F.col("n") > F.col("total") * F.lit(share)).select(key)
    return [r[0] for r in rows.collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "left",
               share: float = HOT_SHARE) -> DataFrame:
    """``left.join(right, key, how)`` for a ``right`` with at most one row a key.

    Rows of ``left`` under a hot key never move: they meet the rows of
    ``right`` for those keys (fewer than ``1 / share``, as right is unique)
    by a broadcast join. All others are joined by hash, where no key holds more than ``share`` of the
    rows. Null keys match nothing; they are kept (``how="left"``) without a
    shuffle. The result has the rows of the plain join, in any order.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"split_join can't do {how!r}")
    hot = hot_keys(left, key, share)
    known = left.where(F.col(key).isNotNull())
    parts = []
    if hot:
        is_hot = F.col(key).isin(hot)
        few = right.where(is_hot)
        parts.append(known.where(is_hot).join(F.broadcast(few), key, how))
        known, right = known.where(~is_hot), right.where(~is_hot)
    parts.append(known.join(right, key, how))
    if how == "left":
        parts.append(left.where(F.col(key).isNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out

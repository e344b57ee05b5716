"""Connected components of edge tables, as (node, root) of every node that is not a root itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import cut

ROWS_PER_PARTITION = 200_000


def _sized(df: DataFrame) -> DataFrame:
    """Compute a narrow table once and read it back in partitions of a sensible size."""
    df = cut(df)
    return df.coalesce(1 + df.count() // ROWS_PER_PARTITION)


def follow_parents(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, parent): every round doubles the way each node has gone."""
    now = _sized(parents.select("node", "parent"))
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        moved = _sized(now.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"),
                                                             F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("node", F.col("parent").alias("root"))
        now = moved.select("node", "parent")


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Connect the neighbours v of every u that ``keep`` selects, and u, to the smallest of them all.

    ``pairs`` has u and v. The smallest neighbour is a map-side combined
    minimum; it is joined back to the pairs, which adaptive execution splits
    where one u has very many.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")) \
        .where("up > 1 or up > 0 and down > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes in ``edges`` (a, b: long); the root is the component's smallest node.

    Alternating large-star and small-star rounds: the edges become stars in a
    number of rounds that grows with the logarithm of the longest path. The
    state is a table in the shared folder; only counts come to the driver.
    """
    now = _sized(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = _star(down, F.lit(True)).where("a <> b").union(
            down.groupBy("u").agg(F.min("v").alias("b")).select(F.col("u").alias("a"), "b"))
        now = _sized(small.distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def merge_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of ``roots`` (node, root) joined by further ``edges`` (a, b), with ends in any of them.

    The edges are drawn between roots first, so only that smaller graph is solved.
    """
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    between = (edges.join(a, "a", "left").join(b, "b", "left")
               .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
               .where("a <> b").distinct())
    joined = connected_components(between)
    if joined.isEmpty():
        return roots
    up = joined.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return _sized(roots.join(up, "root", "left").select("node", F.coalesce("new", "root").alias("root")).union(joined))

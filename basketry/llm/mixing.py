"""Mixing sources to target weights by capped water-filling.

Each source's share of a budget follows its weight, but a source is repeated
at most ``max_epochs`` times: sources whose target would exceed that are
clamped, what they leave is dealt to the others by weight, and so on until no
target is above its cap. Documents are then taken in the order of a seeded
hash of their id: every one ``floor(target / size)`` whole times, and once
more while the running size stays nearest the rest of the target. So each
source's words end within half a document of its target, and no document is
taken more than ``max_epochs`` times.

All of it is DataFrame expressions. The running size over a source is a
two-level prefix sum: per (source, hash slice) first, then inside the slice,
so a source with a third of all rows is spread over thousands of groups. Only
sums over all sources (a few numbers a round) come to the driver.

Defined cases: null and empty texts have size 0 and are never repeated in
words; a null source is a source of its own, sorted last; rows that repeat an
id share its hash and are taken in order of size; ties in the hash are broken
by id, then size; an empty table, or one without words, gives target 0
throughout; other columns are ignored whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import WORD, cut, text_or_empty

SLICE_BITS = 12
HASH_BITS = 48
BROADCAST_SOURCES = 10_000      # rows of about 100 bytes each


def n_words(text: str | Column) -> Column:
    """Number of words of the whole text (null: 0)."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def seeded_hash(id_col: str, seed: str) -> Column:
    """A 48-bit hash of seed and id, the same on every run and engine."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def rank_sources(sources: DataFrame) -> DataFrame:
    """Add ``rank``: 0, 1, ... by code point, null last, without one task seeing all sources.

    The sources are range-partitioned; each partition is numbered by itself
    and shifted by the sizes of the partitions before it (one number each).
    """
    ordered = cut(sources.repartitionByRange(F.col("source").asc_nulls_last())
                  .withColumn("part", F.spark_partition_id()))
    before, shift = 0, {}
    for row in ordered.groupBy("part").count().orderBy("part").collect():   # one row a partition
        shift[row["part"]] = before
        before += row["count"]
    at = F.create_map(*[F.lit(x) for kv in shift.items() for x in kv]) if shift else None
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    rank = (inside + at[F.col("part")]) if shift else F.lit(0)
    return ordered.withColumn("rank", rank.cast("long")).drop("part")


def water_fill(sources: DataFrame, budget: Fraction, max_epochs: int) -> DataFrame:
    """Add ``target`` to sources (size, weight): clamp at ``max_epochs`` sizes, reshare the rest.

    ``budget`` is a multiple of all sizes. The level of the water is the exact
    fraction p / q; a source is clamped if p * weight > max_epochs * size * q.
    Every round is one sum over the sources, and the level only rises, so it
    ends as soon as a round clamps nothing more.
    """
    def big(x):
        return x.cast("decimal(38,0)") if isinstance(x, Column) else F.lit(str(x)).cast("decimal(38,0)")

    total = sources.agg(F.sum("size")).first()[0] or 0
    level, clamped_before = None, -1
    while True:
        over = F.lit(False) if level is None else (
            big(level.numerator) * big(F.col("weight")) > big(max_epochs * level.denominator) * big(F.col("size")))
        s = sources.agg(F.count(F.when(over, 1)).alias("n"),
                        F.sum(F.when(over, F.col("size"))).alias("size"),
                        F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if s["n"] == clamped_before or not s["weight"]:
            break
        clamped_before = s["n"]
        level = (budget * total - max_epochs * (s["size"] or 0)) / s["weight"]
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    over = (big(level.numerator) * big(F.col("weight")) > big(max_epochs * level.denominator) * big(F.col("size")))
    share = (F.col("weight") * F.lit(level.numerator)).cast("double") / F.lit(level.denominator).cast("double")
    cap = (F.col("size") * max_epochs).cast("double")
    return sources.withColumn("target", F.when(over, cap).otherwise(share))


def sized_rows(df: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> DataFrame:
    """(id, source, size, hash, slice) of every row; the text is read here and nowhere else."""
    return (df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                      n_words(text_col).alias("size"), seeded_hash(id_col, seed).alias("hash"))
            .withColumn("slice", F.shiftright("hash", HASH_BITS - SLICE_BITS)))


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: Fraction = Fraction(3, 2),
             max_epochs: int = 2) -> DataFrame:
    """One row per source: source, source_size, target, whole, last.

    A row of the source is taken ``whole`` times, and once more if its
    (hash, id, size) is at most ``last``. ``weights`` are dealt to the sources
    in order, repeating; ``budget`` is the mix's size as a multiple of all sizes.
    """
    slices = cut(rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")))
    sources = rank_sources(slices.groupBy("source").agg(F.sum("slice_size").alias("size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = water_fill(cut(sources.withColumn("weight", weight.cast("long"))), budget, max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    sources = cut(sources.withColumn("whole", F.least(whole, F.lit(max_epochs)).cast("long"))
                  .withColumn("rest", F.col("target") - F.col("whole") * F.col("size"))
                  .select("source", F.col("size").alias("source_size"), "target", "whole", "rest"))

    # the slice in which the running size passes the rest of the target, per source
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    s, t = slices.alias("s"), sources.alias("t")
    edge = (s.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).alias("s")
            .join(t, F.col("s.source").eqNullSafe(F.col("t.source")))
            .where(F.col("before") < F.col("rest"))
            .groupBy("t.source", "rest")
            .agg(F.max(F.struct("slice", "before")).alias("at"))
            .select("source", "rest", "at.slice", "at.before"))
    e, r = edge.alias("e"), rows.alias("r")
    inside = (r.join(e, F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.slice") == F.col("e.slice")))
              .select("r.id", "r.source", "r.size", "r.hash", "r.slice", "e.rest", "e.before"))
    running = Window.partitionBy("source").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    taken = (2 * start + F.col("size")).cast("double") < 2 * F.col("rest")
    key = F.struct("hash", "id", "size")
    last = (inside.withColumn("taken", taken).groupBy("source")
            .agg(F.max(F.when(F.col("taken"), key)).alias("last"),
                 (F.shiftleft(F.max("slice"), HASH_BITS - SLICE_BITS) - 1).alias("below")))
    u, v = sources.alias("u"), last.alias("v")
    return cut(u.join(v, F.col("u.source").eqNullSafe(F.col("v.source")), "left")
               .select("u.source", "source_size", "target", "whole", "last", "below"))


def attach(rows: DataFrame, plan: DataFrame, max_epochs: int = 2) -> DataFrame:
    """Add source_size, target and ``times`` to rows with source, id, hash and size.

    The plan (one row per source) is broadcast only if counting shows it small.
    """
    plan = plan.withColumnRenamed("source", "plan_source")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    more = F.when(F.col("last").isNotNull(), F.struct("hash", "id", "size") <= F.col("last")) \
        .otherwise(F.col("hash") <= F.col("below"))
    times = F.col("whole") + F.when(more, 1).otherwise(0)
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
            .withColumn("times", F.least(times, F.lit(max_epochs)).cast("int"))
            .drop("plan_source", "whole", "last", "below"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights: tuple[int, ...] = (3, 1, 2), budget: Fraction = Fraction(3, 2), max_epochs: int = 2,
                seed: str = "mix") -> DataFrame:
    """One row per row of ``df``: id, source, size, source_size, target, times, taken (words)."""
    rows = cut(sized_rows(df, id_col, source_col, text_col, seed))
    out = attach(rows, plan_mix(rows, weights, budget, max_epochs), max_epochs)
    return out.select("id", "source", "size", "source_size", "target", "times",
                      (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mix_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                  weights: tuple[int, ...] = (3, 1, 2), budget: Fraction = Fraction(3, 2), max_epochs: int = 2,
                  seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``df`` with their columns, each as often as it is taken.

    Texts are not shuffled: the plan is computed from narrow rows, then each
    row is decided where it is read.
    """
    rows = cut(sized_rows(df, id_col, source_col, text_col, seed))
    plan = plan_mix(rows, weights, budget, max_epochs)
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                    F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                    n_words(text_col).alias("size"), seeded_hash(id_col, seed).alias("hash"))
    mixed = attach(own, plan, max_epochs).where("times > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("time")).select("row.*")

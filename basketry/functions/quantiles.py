"""Exact, distributed quantiles with linear interpolation.

pandas ``Series.quantile`` and DuckDB ``quantile_cont`` interpolate between
the two order statistics around ``(n - 1) * q``. Spark's ``percentile``
aggregate gives the same numbers on small data but keeps every distinct value
of the column in the single task that finishes a global aggregate, which does
not hold on a very large table.

Here the needed order statistics are found by narrowing, for all requested
columns and ranks at once, in one way at every size:

1. A column's open ranks lie in a few disjoint intervals of values, at first in
   one. Their values together are the column's space, and one
   ``percentile_approx`` sketch a column (fixed size, merged map-side) estimates
   all its ranks in it, each with a margin of the sketch's error on both sides.
2. One counting pass measures the rows on each of these values and between
   them. A rank on a value is answered at once (heavy ties never stall the
   search, and columns shorter than the accuracy end in the first round);
   otherwise the rows between two neighbouring values (about ``2 n / accuracy``)
   are the rank's next interval.

The counts are exact, so a sketch that misses costs a round and no more; every
round takes its values out of the space, so the search ends. A round is two
Spark jobs whatever the number of columns and ranks, no task keeps more than
the sketches, and only a handful of numbers ever reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir

ACCURACY = 10_000


def _value(column: str) -> Column:
    """The column as double; NaN counts as missing (pandas skips both)."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


Interval = tuple[float | None, float | None]      # lo < x < hi (None: open)


@dataclass
class _Search:
    rank: int                       # wanted rank inside the interval
    at: Interval = (None, None)
    value: float | None = None
    done: bool = False


@dataclass
class _Space:
    """The open searches of a column and the sizes of their intervals."""

    column: str
    searches: list[_Search]
    sizes: dict[Interval, int]

    def intervals(self) -> list[Interval]:
        open_ = {s.at for s in self.searches if not s.done}
        return sorted(open_, key=lambda i: -math.inf if i[0] is None else i[0])

    def inside(self) -> Column:
        """Whether the column's value is in one of the intervals."""
        v, cond = _value(self.column), F.lit(False)
        for lo, hi in self.intervals():
            one = v.isNotNull()
            if lo is not None:
                one = one & (v > F.lit(lo))
            if hi is not None:
                one = one & (v < F.lit(hi))
            cond = cond | one
        return cond

    def probabilities(self, accuracy: int) -> list[float]:
        """Where the open ranks lie in the space, with the sketch's margin on both sides."""
        before, total = {}, 0
        for i in self.intervals():
            before[i] = total
            total += self.sizes[i]
        out = set()
        for s in self.searches:
            if not s.done:
                p = (before[s.at] + s.rank + 0.5) / total      # the smallest value with this share of rows has the rank
                out |= {max(0.0, p - 1.0 / accuracy), p, min(1.0, p + 1.0 / accuracy)}
        return sorted(out)

    def narrow(self, points: list[float], on: list[int], between: list[int]) -> None:
        """Answer the searches whose rank is on a point; give the others the interval their rank is in.

        ``on`` counts the space's rows on each point, ``between`` those before
        the first, between neighbours and behind the last.
        """
        before, total = {}, 0
        for i in self.intervals():
            before[i] = total
            total += self.sizes[i]
        sizes: dict[Interval, int] = {}
        for s in self.searches:
            if s.done:
                continue
            at = before[s.at] + s.rank
            for k, gap in enumerate(between):
                if at < gap:
                    lo, hi = (points[k - 1] if k else None), (points[k] if k < len(points) else None)
                    s.at, s.rank = (lo, hi), at
                    sizes[s.at] = gap
                    break
                at -= gap
                if at < on[k]:
                    s.value, s.done = points[k], True
                    break
                at -= on[k]
        self.sizes = sizes


def _narrow_round(df: DataFrame, spaces: list[_Space], accuracy: int) -> None:
    """One sketch and one counting pass over all columns with open searches."""
    found = df.agg(*[F.percentile_approx(F.when(s.inside(), _value(s.column)), s.probabilities(accuracy), accuracy)
                     .alias(f"p{i}") for i, s in enumerate(spaces)]).first()
    points = []
    for i, s in enumerate(spaces):
        # the ends of intervals are points as well, so nothing between two points is in two intervals
        ends = {x for interval in s.intervals() for x in interval if x is not None}
        points.append(sorted({*found[f"p{i}"]} | ends))
    values = df.select(*[F.when(s.inside(), _value(s.column)).alias(f"v{i}") for i, s in enumerate(spaces)])
    cells = [F.struct(F.lit(i).alias("space"), _cell(F.col(f"v{i}"), x, 0, len(x)).alias("cell")) for i, x in enumerate(points)]
    counted = (values.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("cell").isNotNull())
               .groupBy("space", "cell").agg(F.count(F.lit(1)).alias("n")).collect())     # a few cells a rank
    n = {(r["space"], r["cell"]): r["n"] for r in counted}
    for i, s in enumerate(spaces):
        k = len(points[i])
        s.narrow(points[i], [n.get((i, 2 * j + 1), 0) for j in range(k)], [n.get((i, 2 * j), 0) for j in range(k + 1)])


def _cell(v: Column, points: list[float], first: int, end: int) -> Column:
    """2 k + 1 for a value on point k, 2 k for one before it and behind the point before; by bisection."""
    if first == end:
        return F.when(v.isNotNull(), F.lit(2 * first))
    mid = (first + end) // 2
    return (F.when(v < F.lit(points[mid]), _cell(v, points, first, mid))
            .when(v == F.lit(points[mid]), F.lit(2 * mid + 1)).otherwise(_cell(v, points, mid + 1, end)))


def _order_statistics(df: DataFrame, wanted: dict[str, tuple[int, list[int]]],
                      accuracy: int) -> dict[str, dict[int, float]]:
    """``{column: (n, ranks)}`` -> ``{column: {rank: value}}`` (0-based ranks)."""
    spaces = {c: _Space(c, [_Search(r) for r in ranks], {(None, None): n}) for c, (n, ranks) in wanted.items()}
    while open_ := [s for s in spaces.values() if s.intervals()]:
        _narrow_round(df, open_, accuracy)
    return {c: {r: s.value for r, s in zip(ranks, spaces[c].searches)} for c, (_, ranks) in wanted.items()}


def _between(a: float, b: float, t: Fraction) -> float:
    """a + (b - a) * t, evaluated exactly and rounded once (DuckDB's quantile_cont gives the
    same; plain doubles can differ in the last bit). An infinite end with a share wins."""
    if a == b or not t:
        return float(a)
    if math.isinf(a) or math.isinf(b):
        return float(a + b)              # opposite infinities: NaN
    return float(Fraction(a) + (Fraction(b) - Fraction(a)) * t)


def exact_quantiles_multi(df: DataFrame, spec: dict[str, list[float]], *,
                          accuracy: int = ACCURACY, counts: dict[str, int] | None = None
                          ) -> tuple[dict[str, list[float | None]], dict[str, int]]:
    """Quantiles of several columns: one counting pass (unless ``counts`` are given), then the shared search.

    Returns ``({column: [quantile per probability]}, {column: non-null count})``.
    """
    cols = list(spec)
    if counts is None:
        row = df.agg(*[F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        counts = {c: int(row[f"n{i}"]) for i, c in enumerate(cols)}
    plan, wanted = {}, {}
    for c in cols:
        n = counts[c]
        if not n:
            continue
        # exact position (n - 1) * q: no rounding before the interpolation
        plan[c] = [(rn, math.floor(rn), math.ceil(rn))
                   for rn in (Fraction(float(q)) * (n - 1) for q in spec[c])]
        wanted[c] = (n, sorted({f for _, f, _ in plan[c]} | {k for _, _, k in plan[c]}))
    values = _order_statistics(df, wanted, accuracy) if wanted else {}
    out = {}
    for c in cols:
        if c not in plan:
            out[c] = [None] * len(spec[c])
            continue
        v = values[c]
        out[c] = [_between(v[f], v[k], rn - f) for rn, f, k in plan[c]]
    return out, counts


def exact_quantiles(df: DataFrame, column: str, probs: list[float], *,
                    accuracy: int = ACCURACY) -> list[float | None]:
    """Linear-interpolated quantiles of ``column`` (nulls and NaN skipped).

    Returns ``None`` for every probability when no value is present.
    """
    out, _ = exact_quantiles_multi(df, {column: list(probs)}, accuracy=accuracy)
    return out[column]


def grouped_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The ``keys`` and the exact median of every column, one row per group.

    Equal values of a group are folded into one block (map-side combined), the
    blocks are range-partitioned by (group, column, value), every partition
    counts its own part of each group, and the counts of the parts before it
    shift its ranks. So a group with a third of all rows is spread over many
    tasks, and none holds a group's values. Nulls are skipped, NaN ranks above
    every number; a group without values has a null median; null keys are a group.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, names)]
    values = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    groups = [*names, "_c"]
    blocks = (df.select(*own, F.inline(values)).groupBy(*groups, "_v")
              .agg(F.count(F.lit(1)).alias("_n")))
    ensure_checkpoint_dir(df.sparkSession)
    blocks = (blocks.repartitionByRange(*groups, "_v").withColumn("_part", F.spark_partition_id())
              .checkpoint(eager=True))
    rows = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    parts = blocks.groupBy(*groups, "_part").agg(F.sum(rows).alias("_rows"))
    whole, earlier = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy("_part")
    parts = parts.select(*[F.col(g).alias(f"{g}s") for g in groups], F.col("_part").alias("_at"),
                         (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_shift"),
                         F.sum("_rows").over(whole).alias("_total"))
    same = F.col("_part") == F.col("_at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}s"))
    inside = Window.partitionBy(*groups, "_part").orderBy(F.col("_v").asc_nulls_last())
    end = F.col("_shift") + F.sum(rows).over(inside)
    ranked = blocks.join(parts, same).select(*groups, "_v", "_total", end.alias("_end"), (end - rows).alias("_start"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")
    two = ranked.groupBy(*groups).agg(at(low).alias("_low"), at(high).alias("_high"))
    middle = F.when(F.col("_low") == F.col("_high"), F.col("_low")) \
        .otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * 0.5)
    return two.withColumn("_m", middle).groupBy(*names).agg(
        *[F.max(F.when(F.col("_c") == i, F.col("_m"))).alias(c) for i, c in enumerate(columns)]) \
        .select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *columns)

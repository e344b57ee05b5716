"""Near-duplicate documents by min-max hashing, with links confirmed on full sets.

A document's set holds its distinct word shingles. Under each of ``hashes``
permutations (a keyed bijection of 64-bit shingle hashes) both the smallest
and the largest image are kept, two signature values for one evaluation.
Bands of ``rows`` values, each from different permutations and all smallest or
all largest, give bucket keys; documents that share a bucket are candidates.
With the defaults a pair of similarity 0.8 shares none of its 36 buckets with
probability 6e-7.

Documents with the same set are one node. Buckets are not expanded into all
pairs. Links are sought in three steps, each confirming candidates on the full
sets and joining components; the centre of a bucket is its node that meets
most others over all its buckets:

1. every node against the most central of its buckets' centres;
2. across components only, every node against the centre of each bucket;
3. across components only, the remaining pairs of each bucket, where one side
   is outside the bucket's largest component. Buckets with more than
   ``hot_bucket`` nodes outside it (texts around one template that are not
   linked) are replaced by a prefix-filter join: of the shingles that two
   nodes of such buckets share, ordered rarest first, one is among the first
   of both sets, and it must leave enough shingles after it on both sides.

A pair whose ends are already in one component needs no check, so a large
group of near copies costs a few checks a copy. Steps 2 and 3 also leave out
pairs that can't be linked: sizes too different, or a bitmap filter (Bloom
bits of both sets: no more items can be common than bits are, plus the
smaller number of items that share bits). No pair is left out that could be
linked.

Defined cases: a null or empty text, or one without words, has an empty set and
is linked with nothing; a text with fewer words than a shingle is one shingle;
rows that repeat (id or text) are linked; a component's id is its smallest
non-null document id, null if there is none; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import WordHashes, cut, mix64, text_or_empty
from basketry.llm.components import follow_parents, merge_components

BROADCAST_IDS = 200_000


@dataclass(frozen=True)
class NearConfig:
    """Shingle length, similarity as a percentage, signature and bands."""
    shingle: int = 5
    percent: int = 80
    hashes: int = 90
    rows: int = 5
    bitmap_words: int = 32          # 64 bits each
    hot_bucket: int = 64            # nodes outside a bucket's largest component
    seed: int = 20240501

    @property
    def bands(self) -> int:
        return 2 * (self.hashes // self.rows)


def shingle_set(text: str | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles (A-Z lower-cased)."""
    words = text.encode().lower().split() if text else []       # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = known.of(words)
    n = min(n, len(w))
    m = len(w) - n + 1
    h = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        h = mix64(h) + w[k:k + m]
    return np.unique(mix64(h))


def set_digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


class MinMax:
    """Min-max signatures and their band keys."""

    def __init__(self, c: NearConfig):
        rng = np.random.default_rng(c.seed)
        self.c = c
        self.a = rng.integers(0, 2**63, c.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = mix64(np.arange(1, c.bands + 1, dtype=np.uint64))

    def signature(self, values: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest image of the set under each permutation."""
        low = np.full(self.c.hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
        high = np.zeros(self.c.hashes, dtype=np.uint64)
        for at in range(0, len(values), block):
            y = self.a[:, None] * values[None, at:at + block]
            np.minimum(low, y.min(axis=1), out=low)
            np.maximum(high, y.max(axis=1), out=high)
        return low, high

    def keys(self, values: np.ndarray) -> np.ndarray:
        """One bucket key a band."""
        used = self.c.hashes // self.c.rows * self.c.rows
        parts = np.concatenate([s[:used].reshape(-1, self.c.rows) for s in self.signature(values)])
        h = self.band.copy()
        for k in range(self.c.rows):
            h = mix64(h ^ parts[:, k])
        return h


def signatures(text_col: str | Column, c: NearConfig) -> Column:
    """Struct of n (set size), digest (of the set) and keys (one a band; none for an empty set)."""
    @F.arrow_udf("struct<n:long,digest:binary,keys:array<long>>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, minmax = WordHashes(), MinMax(c)
        for texts in batches:
            sets = [shingle_set(t, c.shingle, known) for t in texts.to_pylist()]
            keys = [minmax.keys(s).view(np.int64) if len(s) else None for s in sets]
            yield pa.StructArray.from_arrays(
                [pa.array([len(s) for s in sets], type=pa.int64()),
                 pa.array([set_digest(s) for s in sets], type=pa.binary()),
                 pa.array(keys, type=pa.list_(pa.int64()))], names=["n", "digest", "keys"])

    return compute(F.col(text_col) if isinstance(text_col, str) else text_col)


def bitmap(values: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words with the bit of every item set."""
    bits = np.zeros(64 * words, dtype=bool)
    bits[((values >> np.uint64(24)) % np.uint64(64 * words)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def full_sets(text_col: str | Column, c: NearConfig) -> Column:
    """Struct of digest, items (the sorted set as little-endian 64-bit integers) and the words of its bitmap."""
    words = [f"b{k}" for k in range(c.bitmap_words)]

    @F.arrow_udf("struct<digest:binary,items:binary," + ",".join(f"{w}:long" for w in words) + ">")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WordHashes()
        for texts in batches:
            sets = [shingle_set(t, c.shingle, known) for t in texts.to_pylist()]
            bits = np.array([bitmap(s, c.bitmap_words) for s in sets], dtype=np.int64).reshape(len(sets), len(words))
            yield pa.StructArray.from_arrays(
                [pa.array([set_digest(s) for s in sets], type=pa.binary()),
                 pa.array([s.tobytes() for s in sets], type=pa.binary()),
                 *[pa.array(bits[:, k], type=pa.int64()) for k in range(len(words))]], names=["digest", "items", *words])

    # else the optimizer moves a filter on the result, and the function with it, below the join
    return compute.asNondeterministic()(F.col(text_col) if isinstance(text_col, str) else text_col)


def bits_fit(x: str, y: str, c: NearConfig) -> Column:
    """Whether the bitmaps of nodes ``x`` and ``y`` leave a link possible.

    A common item sets a common bit; of the items beyond the first on a bit
    (n less the bits set) at most the smaller number can be common.
    """
    def ones(of):
        return sum((F.bit_count(of(f"b{k}")) for k in range(1, c.bitmap_words)), F.bit_count(of("b0")))

    common = ones(lambda b: F.col(f"{x}.{b}").bitwiseAND(F.col(f"{y}.{b}"))) + F.least(F.col(f"{x}.beyond"),
                                                                                        F.col(f"{y}.beyond"))
    return 100 * common >= c.percent * (F.col(f"{x}.n") + F.col(f"{y}.n") - common)


def common_items(a: str, b: str) -> Column:
    """Size of the intersection of two sorted sets."""
    @F.arrow_udf("long")
    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            both = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
            both.sort(kind="stable")                     # merges two sorted runs
            out.append(int((both[1:] == both[:-1]).sum()))
        return pa.array(out, type=pa.int64())

    return count(F.col(a), F.col(b))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``common``, the size of the sets' intersection, to pairs (a, b, n_a, n_b)."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    return cut(pairs.join(left, "a").join(right, "b")
               .select("a", "b", "n_a", "n_b", common_items("items_a", "items_b").alias("common")))


def linked(c: NearConfig) -> Column:
    return 100 * F.col("common") >= c.percent * (F.col("n_a") + F.col("n_b") - F.col("common"))


def sizes_fit(n_a: Column, n_b: Column, c: NearConfig) -> Column:
    return 100 * F.least(n_a, n_b) >= c.percent * F.greatest(n_a, n_b)


def set_items(items: str) -> Column:
    """The items of a set as an array."""
    @F.arrow_udf("array<long>")
    def read(values: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(v.as_buffer(), np.int64) for v in values], type=pa.list_(pa.int64()))

    return read(F.col(items))


def outside_largest(rows: DataFrame, key: str) -> DataFrame:
    """Add ``outside``: whether the row's root is not the most frequent one under its key."""
    largest = (rows.groupBy(key, "root").agg(F.count(F.lit(1)).alias("n")).groupBy(key)
               .agg(F.max(F.struct("n", "root")).alias("largest")).select(key, F.col("largest.root").alias("main")))
    return rows.join(largest, key).withColumn("outside", F.col("root") != F.col("main"))


def prefixes(nodes: DataFrame, sets: DataFrame, c: NearConfig) -> DataFrame:
    """(token, node, n, root, at, short) of the first items, rarest first, of each node's set.

    ``at`` counts from 1. A set linked to one not larger shares an item within these rows
    with it, and that item is within the smaller one's ``short`` rows.
    """
    tokens = (nodes.select("node", "n", "root").join(sets.select("node", "items"), "node")
              .select("node", "n", "root", F.explode(set_items("items")).alias("token")))
    # an item of one node only takes a place in its order, and nothing else
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held_by")).where("held_by > 1")
    one = Window.partitionBy("node")
    at = F.col("n") - F.count(F.lit(1)).over(one) + F.row_number().over(one.orderBy("held_by", "token"))
    left = F.col("n") - F.col("at") + 1         # items from this one on
    return (tokens.join(shared, "token").withColumn("at", at)
            .where(100 * left >= c.percent * F.col("n"))
            .select("token", "node", "n", "root", "at", ((100 + c.percent) * left >= 2 * c.percent * F.col("n")).alias("short")))


def prefix_pairs(nodes: DataFrame, sets: DataFrame, c: NearConfig) -> DataFrame:
    """Distinct pairs (a, b, n_a, n_b) of nodes of different roots that may be linked, by their prefixes."""
    rows = prefixes(nodes, sets, c)
    several = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    rows = cut(outside_largest(rows.join(several.select("token"), "token", "left_semi"), "token"))

    def enough(side: str) -> Column:
        return (100 + c.percent) * (F.col(f"{side}.n") - F.col(f"{side}.at") + 1) >= c.percent * (F.col("x.n") + F.col("y.n"))

    def meet(larger: DataFrame, smaller: DataFrame) -> DataFrame:
        ordered = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") > F.col("y.node")))
        fit = ((F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & ordered
               & sizes_fit(F.col("x.n"), F.col("y.n"), c) & enough("x") & enough("y"))
        return (larger.alias("x").join(smaller.where("short").alias("y"), fit)
                .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n_a"),
                        F.col("y.n").alias("n_b")))

    # members of a token's largest component never meet one another
    met = meet(rows, rows.where("outside")).unionByName(meet(rows.where("outside"), rows.where("not outside"))).distinct()
    bits = sets.drop("items").join(nodes.select("node", "n"), "node")
    return (met.join(bits.alias("x"), F.col("a") == F.col("x.node")).join(bits.alias("y"), F.col("b") == F.col("y.node"))
            .where(bits_fit("x", "y", c)).select("a", "b", "n_a", "n_b"))


def node_components(nodes: DataFrame, df: DataFrame, id_col: str, text_col: str, c: NearConfig) -> DataFrame:
    """(node, root) of the nodes linked to another, but for the roots.

    ``nodes``: node, row (id and text_key of a row that holds the set), digest, n, keys.
    """
    buckets = nodes.select("node", "n", F.explode("keys").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = cut(buckets.join(shared, "bucket"))
    # how many others a node meets, and the centre of each bucket
    weight = met.groupBy("node").agg(F.sum("members").alias("weight"))
    centres = met.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("centre"))
    members = cut(met.select("node", "n", "bucket").join(centres, "bucket"))
    involved = cut(weight.select("node").join(nodes.select("node", "row", "digest", "n"), "node"))
    size = involved.select("node", "n")

    # the full sets of candidates, from the texts; the hash of the text keeps rows that share an id apart
    wanted = involved.select(F.col("row.id").alias("__id"), F.col("row.text_key").alias("__text_key"),
                             F.col("node").alias("__node"), F.col("digest").alias("__digest"), F.col("n").alias("__n"))
    if involved.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    words = [f"b{k}" for k in range(c.bitmap_words)]
    beyond = F.col("__n") - sum((F.bit_count(F.col(f"s.{w}")) for w in words[1:]), F.bit_count(F.col("s.b0")))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                      F.xxhash64(text_or_empty(text_col)).alias("text_key"))
    sets = cut(texts.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__text_key")))
               .select("__node", "__digest", "__n", full_sets("text", c).alias("s"))
               .where(F.col("s.digest") == F.col("__digest"))
               .select(F.col("__node").alias("node"), F.col("s.items").alias("items"),
                       *[F.col(f"s.{w}").alias(w) for w in words], beyond.alias("beyond")).dropDuplicates(["node"]))

    # step 1: the most central node met in any bucket
    first = (members.groupBy("node").agg(F.max("centre").alias("centre"), F.first("n").alias("n_a"))
             .select(F.col("node").alias("a"), F.col("centre.node").alias("b"), "n_a").where("a <> b"))
    first = first.join(size.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    checked = confirm(first.where(sizes_fit(F.col("n_a"), F.col("n_b"), c)), sets).where(linked(c))
    # each link leads to a more central node, so the links are a forest
    roots = follow_parents(checked.select(F.col("a").alias("node"), F.col("b").alias("parent")))

    def open_buckets(roots: DataFrame) -> DataFrame:
        """Members, with root and bitmap, of the buckets that hold more than one component."""
        rows = (members.select("node", "n", "bucket", F.col("centre.node").alias("centre")).join(roots, "node", "left")
                .withColumn("root", F.coalesce("root", "node")))
        several = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        rows = rows.join(several.select("bucket"), "bucket", "left_semi")
        return cut(rows.join(sets.drop("items"), "node"))

    def pairs(x: DataFrame, y: DataFrame, more: Column) -> DataFrame:
        """Distinct candidate pairs (a, b, n_a, n_b) of rows of x and y in one bucket, across components."""
        fit = ((F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root"))
               & sizes_fit(F.col("x.n"), F.col("y.n"), c) & bits_fit("x", "y", c) & more)
        return (x.alias("x").join(y.alias("y"), fit)
                .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n_a"),
                        F.col("y.n").alias("n_b")).distinct())

    # step 2: the centre of each bucket, across components
    rows = open_buckets(roots)
    star = pairs(rows, rows.where("node = centre"), F.lit(True))
    roots = merge_components(roots, confirm(star, sets).where(linked(c)))

    # step 3: what is left of each bucket, across components; both sides of a pair
    # can't be in the bucket's largest component, so one side is read without it. Hot
    # buckets give way to the prefixes of their nodes
    rows = outside_largest(open_buckets(roots).where("node <> centre"), "bucket")
    hot = cut(rows.where("outside").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > c.hot_bucket).select("bucket"))
    once = ~F.col("y.outside") | (F.col("x.node") > F.col("y.node"))
    cool = rows.join(hot, "bucket", "left_anti")
    rest = pairs(cool.where("outside"), cool, once)
    if not hot.isEmpty():
        nodes_of_hot = rows.join(hot, "bucket", "left_semi").select("node", "n", "root").dropDuplicates(["node"])
        rest = rest.unionByName(prefix_pairs(cut(nodes_of_hot), sets, c)).distinct()
    return merge_components(roots, confirm(rest, sets).where(linked(c)))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                config: NearConfig = NearConfig()) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept, text_key (a hash of the text), root.

    Rows of one component have the same ``root``; it is null for a row alone in its own.
    """
    rows = cut(df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_key"),
                         signatures(text_col, config).alias("s")).select("id", "text_key", "s.*"))
    nodes = cut(rows.where(F.col("digest").isNotNull()).groupBy("digest")
                .agg(F.min("id").alias("id"), F.min(F.struct("id", "text_key")).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"),
                     F.count(F.lit(1)).alias("copies"))
                .withColumn("node", F.monotonically_increasing_id()))
    roots = node_components(nodes, df, id_col, text_col, config)
    of = (nodes.select("node", "digest", "id", "copies").join(roots, "node", "left")
          .withColumn("root", F.coalesce("root", "node")))
    least = of.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("copies").alias("size"))
    # a document alone in its component needs no lookup
    named = of.join(least.where("size > 1"), "root").select("digest", "component_id", "root")
    out = rows.select("id", "text_key", F.col("n").alias("n_shingles"), "digest").join(
        named.withColumn("grouped", F.lit(True)), "digest", "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "n_shingles", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), "text_key", "root")

"""Trie of conversation prefixes by vertical bitmaps.

Every distinct sequence of the first d turns (role, text) of the conversations is
a node. Turns are reduced to narrow rows first (128-bit digest of role and text,
number of words), so texts are read once and never shuffled. Conversations are
cut into shards, ranges of conversation ids of a bounded count, and positions into
bands, so that neither a long conversation nor a common prefix makes a task large.

In a (shard, band) the postings of every (position, turn) are a bitset over the
shard's conversations. A depth-first walk intersects a node's bitset with the
posting of the next turn of its lowest member: what comes out is a child, its
popcount the child's conversations, and the members whose conversation is over
its list of ends; the rest of the bitset gives the next child. So a node costs
one intersection, whatever the number of postings.

A node's key is the exclusive or of hashes of (position, turn) along its path
(two of 64 bits), which can be started at any band from sums of the earlier
ones. Equal keys of several shards are merged by ordinary aggregates. What is
summed over a subtree is drawn from sums over members, which shards can add up:

* a childless node belongs to the smallest conversation that ends in it, so
  ``n_leaves`` is the number of members that own such a node;
* the words of a node's subtree, each node as often as it has members, are the
  members' words behind the node; each node once, the words of the nodes that a
  member owns (of which it is the smallest member: the end of its path).

These sums are taken over the same bitsets in a second pass, only for nodes with
two conversations or more; others have one leaf and nothing to save. Lists of
ends are hashed as a stream in the order of shards; one node's digest needs its
ids one after the other, but never more than a shard's list at a time.

Defined cases: turns are ordered by turn, null first, ties by the digest of role
and text; null role or text is empty; rows that repeat a turn are turns of their
own; rows without conversation id belong to no conversation and are left out; a
conversation without turns ends in the root; an empty table has no node, not
even the root; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import cut, text_or_empty
from basketry.llm.mixing import n_words

NODE_KEY = ("a", "b", "depth")
PARTS = ("shard long, band long, a long, b long, depth long, parent_a long, parent_b long, conv_id long, n long, "
         "words long, above long, members binary, ends array<long>")
SUMS = "a long, b long, depth long, all_words long, own_words long, leaves long"
DIGESTS = "a long, b long, depth long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieConfig:
    shard_convs: int = 2048       # conversations of a shard: bits of a bitset
    band: int = 256               # positions of a band


def number_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, position, d1, d2, words) of every turn; positions count from 0.

    Rows are range-partitioned by (conversation, turn), so a conversation with a
    third of all rows is spread over many tasks; each numbers its own part and
    adds the sizes of the conversation's earlier parts.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"),
        n_words(text).alias("words"))
    order = (F.col("turn").asc_nulls_first(), F.col("digest"))
    rows = cut(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))

    def digits(start: int):       # 60 bits of the digest
        return F.conv(F.substring("digest", start, 15), 16, 10).cast("long")

    return (rows.withColumn("inside", inside).join(shift, ["conv_id", "part"])
            .select("conv_id", (F.col("shift") + F.col("inside") - 1).alias("position"),
                    digits(1).alias("d1"), digits(16).alias("d2"), "words"))


def share_heads(numbered: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuild conversations so that neighbours share prefixes: (turns, conversations).

    The first h turns of conversation c - c % ``every`` come first, then c's own
    turns behind its first h, with h = crc32(decimal c) % ``heads``.
    """
    numbered = cut(numbered)
    c = F.col("conv_id")
    own = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    first = numbered.where((c % every == 0) & (F.col("position") < heads - 1)).withColumnRenamed("conv_id", "base")
    found = first.groupBy("base").agg(F.count(F.lit(1)).alias("found"))
    convs = own.select("conv_id", "own", (c - c % every).alias("base"),
                       (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"))
    taken = F.least("h", F.coalesce("found", F.lit(0)))
    convs = cut(convs.join(found, "base", "left").select(
        "conv_id", "base", "h", taken.alias("k"),
        (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    head = (convs.where("k > 0").join(first, "base").where("position < k")
            .select("conv_id", "position", "d1", "d2", "words"))
    tail = (numbered.join(convs, "conv_id").where("position >= h")
            .select("conv_id", (F.col("position") - F.col("h") + F.col("k")).alias("position"), "d1", "d2", "words"))
    return head.union(tail), convs.select("conv_id", "length")


def conversations_of(numbered: DataFrame) -> DataFrame:
    """(conv_id, length) of the conversations as they are."""
    return numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


def _shards(convs: DataFrame, config: TrieConfig) -> DataFrame:
    convs = cut(convs)
    shards = 1 + convs.count() // config.shard_convs
    return cut(convs.repartitionByRange(shards, "conv_id").withColumn("shard", F.spark_partition_id().cast("long")))


def _banded(numbered: DataFrame, convs: DataFrame, config: TrieConfig) -> DataFrame:
    """Rows of the walk: every turn with its band and the path's key and words before the band; a row a root."""
    def key(seed: int, first: str, second: str):
        return F.xxhash64(F.lit(seed).cast("long"), "position", first, second)

    rows = numbered.join(convs, "conv_id").select(
        "conv_id", "shard", "length", "position", F.floor(F.col("position") / config.band).alias("band"),
        key(1, "d1", "d2").alias("a"), key(2, "d2", "d1").alias("b"), "words")
    so_far = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.where(F.col("length") > config.band).groupBy("conv_id", "band")
              .agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("words").alias("words"))
              .select("conv_id", "band", F.bit_xor("a").over(so_far).alias("start_a"),
                      F.bit_xor("b").over(so_far).alias("start_b"), F.sum("words").over(so_far).alias("start_words")))
    rows = rows.join(starts, ["conv_id", "band"], "left")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("band"), "shard", "length", F.lit(-1).cast("long").alias("position"),
                         *[zero.alias(c) for c in ("a", "b", "words", "start_a", "start_b", "start_words")])
    return rows.unionByName(roots).fillna(0, ["start_a", "start_b", "start_words"])


def _bits(x: int) -> list[int]:
    out = []
    while x:
        low = x & -x
        out.append(low.bit_length() - 1)
        x ^= low
    return out


def walk(t: pa.Table, band_size: int) -> pa.Table:
    """The nodes of one (shard, band), depth first; see the module's text."""
    col = {c: t[c].to_numpy() for c in t.column_names}
    shard, band = int(col["shard"][0]), int(col["band"][0])
    ids, conv = np.unique(col["conv_id"], return_inverse=True)
    at = np.lexsort((col["position"], conv))
    conv, ids_ = conv[at], ids.tolist()
    first = np.searchsorted(conv, np.arange(len(ids)))
    length = col["length"][at][first].tolist()
    a, b, words = (col[c][at].tolist() for c in ("a", "b", "words"))
    row0 = -1 if band == 0 else band * band_size           # position of a conversation's first row here
    end = (band + 1) * band_size
    first_, ords = first.tolist(), conv.tolist()

    postings: dict[tuple[int, int], int] = {}
    for key, c in zip(zip(a, b), ords):
        postings[key] = postings.get(key, 0) | 1 << c
    over: dict[int, int] = {}                               # conversations of each length
    for c, n in enumerate(length):
        over[n] = over.get(n, 0) | 1 << c
    n_bytes = (len(ids) + 7) // 8
    out: list[tuple] = []

    def emit(depth, x, y, px, py, members, w, above):
        n = members.bit_count()
        ended = members & over.get(depth, 0)
        out.append((shard, band, x, y, depth, px, py, ids_[(members & -members).bit_length() - 1], n, w, above,
                    members.to_bytes(n_bytes, "little") if n > 1 else None, [ids_[c] for c in _bits(ended)]))
        return members ^ ended

    stack = []
    if band == 0:
        going = emit(0, 0, 0, None, None, (1 << len(ids)) - 1, 0, 0)
        stack.append((going, 0, 0, 0, 0))
    else:
        starts: dict[tuple[int, int, int], int] = {}
        for c, key in enumerate(zip(*(col[s][at][first].tolist() for s in ("start_a", "start_b", "start_words")))):
            starts[key] = starts.get(key, 0) | 1 << c
        stack = [(members, row0, x, y, above) for (x, y, above), members in starts.items()]
    while stack:
        members, depth, x, y, above = stack.pop()
        if depth == end:
            continue
        while members:
            row = first_[(members & -members).bit_length() - 1] + depth - row0
            child = members & postings[a[row], b[row]]
            members ^= child
            cx, cy = x ^ a[row], y ^ b[row]
            going = emit(depth + 1, cx, cy, x, y, child, words[row], above)
            if going:
                stack.append((going, depth + 1, cx, cy, above + words[row]))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARTS_ARROW)], schema=_PARTS_ARROW)


_PARTS_ARROW = pa.schema([(c, pa.int64()) for c in ("shard", "band", "a", "b", "depth", "parent_a", "parent_b", "conv_id",
                                                    "n", "words", "above")]
                         + [("members", pa.binary()), ("ends", pa.list_(pa.int64()))])


def sum_members(parts: pa.Table, values: pa.Table) -> pa.Table:
    """Sums of the conversations' values over the members of every node of one (shard, band)."""
    if not len(parts):
        return pa.Table.from_arrays([pa.array([], f.type) for f in _SUMS_ARROW], schema=_SUMS_ARROW)
    at = np.argsort(values["conv_id"].to_numpy())
    ids = values["conv_id"].to_numpy()[at]
    x = np.stack([values[c].to_numpy()[at] for c in ("all_words", "own_words", "leaf")], axis=1)
    sums = np.empty((len(parts), 3), dtype=np.int64)
    for k, (members, conv) in enumerate(zip(parts["members"].to_pylist(), parts["conv_id"].to_pylist())):
        if members is None:
            sums[k] = x[np.searchsorted(ids, conv)]
        else:
            bits = np.unpackbits(np.frombuffer(members, dtype=np.uint8), count=len(ids), bitorder="little")
            sums[k] = x[bits.view(bool)].sum(axis=0)
    return pa.Table.from_arrays([parts[c].combine_chunks() for c in NODE_KEY] + [pa.array(sums[:, j]) for j in range(3)],
                                schema=_SUMS_ARROW)


_SUMS_ARROW = pa.schema([(c, pa.int64()) for c in (*NODE_KEY, "all_words", "own_words", "leaves")])


def digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined ids, from rows sorted by node and shard; holds one list at a time."""
    key, sha = None, hashlib.sha256()
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*done)) or [()] * 4
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())],
                                          names=[*NODE_KEY, "ends_sha256"])

    for t in batches:
        for *own, ends in zip(*(t.column(c).to_pylist() for c in range(4))):
            if own != key:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = own, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(map(str, ends)).encode())
        yield batch()
    if key is not None:
        done.append((*key, sha.hexdigest()))
        yield batch()


def build_trie(numbered: DataFrame, convs: DataFrame, config: TrieConfig = TrieConfig()) -> DataFrame:
    """One row per node of turns (conv_id, position, d1, d2, words) and conversations (conv_id, length).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    size = config.band
    numbered, convs = cut(numbered), _shards(convs, config)
    rows = _banded(numbered, convs, config)
    parts = cut(rows.groupBy("shard", "band").applyInArrow(lambda t: walk(t, size), PARTS))

    key = list(NODE_KEY)
    nodes = parts.groupBy(*key).agg(*[F.min(c).alias(c) for c in ("conv_id", "parent_a", "parent_b", "words", "above")],
                                    F.sum("n").alias("n_convs"))
    nodes = cut(nodes)
    children = (nodes.where("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b"),
                                                 (F.col("depth") - 1).alias("depth"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    nodes = cut(nodes.join(children, key, "left").fillna(0, ["n_children"]))

    # of every conversation: its words, those of the nodes it owns, and whether it owns a leaf
    total = numbered.groupBy("conv_id").agg(F.sum("words").alias("all_words"))
    owned = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "above")).alias("first"),
                                         F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    words = F.coalesce("all_words", F.lit(0))
    values = cut(convs.join(total, "conv_id", "left").join(owned, "conv_id", "left").select(
        "conv_id", "shard", "length", words.alias("all_words"), F.col("first.above").alias("above_own"),
        F.when(F.col("first").isNull(), 0).otherwise(words - F.col("first.above")).cast("long").alias("own_words"),
        F.coalesce("leaf", F.lit(0)).alias("leaf")))
    last_band = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / size)
    banded = values.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), last_band)).alias("band"),
                           "conv_id", "all_words", "own_words", "leaf")

    shared = nodes.where("n_convs > 1")
    held = parts.join(shared.select(*key), key).select("shard", "band", *key, "conv_id", "members")
    sums = (held.groupBy("shard", "band").cogroup(banded.groupBy("shard", "band")).applyInArrow(sum_members, SUMS)
            .groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("all_words", "own_words", "leaves")]))
    below = F.col("all_words") - F.col("n_convs") * F.col("above")
    once = F.col("own_words") - (F.col("above") - F.col("above_own"))
    sums = (shared.join(sums, key).join(values.select("conv_id", "above_own"), "conv_id")
            .select(*key, F.col("leaves").alias("n_leaves"), (below - once).alias("saved_tokens")))

    ends = (parts.where(F.size("ends") > 0).select(*key, "ends", "shard").repartition(*key[:2])
            .sortWithinPartitions(*key, "shard").select(*key, "ends").mapInArrow(digest_ends, DIGESTS))
    parents = nodes.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"),
                           (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(parents, ["parent_a", "parent_b", "depth"], "left")
            .join(sums, key, "left").join(ends, key, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                    F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
                    F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", config: TrieConfig = TrieConfig()) -> DataFrame:
    """The trie of conversations as they are."""
    numbered = cut(number_turns(turns, conv_col, turn_col, role_col, text_col))
    return build_trie(numbered, conversations_of(numbered), config)

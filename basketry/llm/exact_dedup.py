"""Exact deduplication against a minimal perfect hash of historical digests.

The history (texts seen earlier) is kept as an index: its distinct SHA-256
digests are spread over shards by digest prefix, and each shard is one row
holding a minimal perfect hash whose slots carry the full digest, the locator
of the winner (its document id) and the number of copies. A new batch is first
reduced to its own distinct digests; each is looked up in its shard, and the
full digest in the slot is compared byte for byte, so a digest that the hash
sends to a foreign slot is a nonmember. Nonmembers form groups of their own.
The winner of a group is the largest document id of history and batch.

Rows with equal text are pre-aggregated before they are shuffled; shards are
sized by the number of distinct digests, so no group of copies makes a shard
large, and the last join (rows to their group) is a plain equi-join on the
digest that adaptive execution splits where one digest is hot.

Defined cases: a null text counts as empty; empty texts equal each other; a
null id loses to every other id, and ``keep_id`` is null only if all ids of
the group are null; rows that repeat an id and its text are all flagged as
kept (the same document); an empty table gives an empty result; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import cut, text_or_empty

INDEX_SCHEMA = ("shard long, n long, level_bits array<long>, bitmaps binary, "
                "digests binary, winners binary, counts binary")
NO_ID = -2**63        # stands for "no id" inside the index; such an id itself is not supported
GAMMA = 2.0           # bits per key of a level of the hash
MAX_LEVELS = 40
SHARD_DIGESTS = 50_000
MIN_SHARDS = 64


def _level_positions(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Position of each 32-byte digest (n x 4 uint64) in the bitmap of a level."""
    a, b = keys[:, level % 4], keys[:, (level + 1) % 4]
    h = (a ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) * (b | np.uint64(1))
    h ^= h >> np.uint64(29)
    return (h % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct digests: cascaded collision-free bitmaps.

    At each level a key owns its position if no other remaining key falls
    there; the others go on to the next level. A key's slot is the rank of its
    position over all levels. Keys left after the last level (only possible if
    digests repeat) would be an error.
    """

    def __init__(self, level_bits: list[int], bitmap: np.ndarray):
        self.level_bits = level_bits
        self.bitmap = bitmap
        self.rank = np.concatenate(([0], np.cumsum(bitmap, dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, maps, left, level = [], [], keys, 0
        while len(left):
            if level == MAX_LEVELS:
                raise ValueError("digests repeat")
            bits = max(8, int(GAMMA * len(left)))
            pos = _level_positions(left, level, bits)
            own = np.bincount(pos, minlength=bits) == 1
            sizes.append(bits)
            maps.append(own)
            left = left[~own[pos]]
            level += 1
        return cls(sizes, np.concatenate(maps) if maps else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has a bit for it (a nonmember)."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, bits in enumerate(self.level_bits):
            if not len(todo):
                break
            pos = base + _level_positions(keys[todo], level, bits)
            hit = self.bitmap[pos]
            out[todo[hit]] = self.rank[pos[hit]]
            todo = todo[~hit]
            base += bits
        return out


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 4)


def _build_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(pdf["digest"])
    mph = PerfectHash.build(keys)
    order = np.argsort(mph.slots(keys))
    winners = pdf["winner"].to_numpy(np.int64)
    return pd.DataFrame([{
        "shard": key[0], "n": len(keys), "level_bits": mph.level_bits,
        "bitmaps": np.packbits(mph.bitmap).tobytes(), "digests": keys[order].tobytes(),
        "winners": winners[order].tobytes(), "counts": pdf["copies"].to_numpy(np.int64)[order].tobytes()}])


def _merge_shard(key: tuple, batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Groups of one shard: the index's slots, with members of the batch merged in, and nonmembers."""
    nonmember = np.ones(len(batch), bool)
    parts = []
    if len(index):
        row = index.iloc[0]
        bits = list(row["level_bits"])
        mph = PerfectHash(bits, np.unpackbits(np.frombuffer(row["bitmaps"], np.uint8),
                                              count=sum(bits)).astype(bool))
        digests = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        winners = np.frombuffer(row["winners"], np.int64).copy()
        counts = np.frombuffer(row["counts"], np.int64).copy()
        if len(batch):
            keys = _keys(batch["digest"])
            slots = mph.slots(keys)
            found = slots >= 0
            found[found] = (digests[slots[found]] == keys[found]).all(axis=1)
            nonmember = ~found
            at = slots[found]
            counts[at] += batch["copies"].to_numpy(np.int64)[found]
            winners[at] = np.maximum(winners[at], batch["winner"].to_numpy(np.int64)[found])
        parts.append(pd.DataFrame({"digest": [d.tobytes() for d in digests],
                                   "keep_id": winners, "group_size": counts}))
    if nonmember.any():
        parts.append(pd.DataFrame({"digest": batch["digest"][nonmember], "keep_id": batch["winner"][nonmember],
                                   "group_size": batch["copies"][nonmember]}))
    return pd.concat(parts, ignore_index=True)


def _groups(rows: DataFrame, shards: int) -> DataFrame:
    """Distinct digests with their winner and number of rows (map-side combined)."""
    return (rows.groupBy("digest").agg(F.coalesce(F.max("id"), F.lit(NO_ID)).alias("winner"), F.count(F.lit(1)).alias("copies"))
            .withColumn("shard", F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"),
                                        F.lit(shards))))


def digest_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row: SHA-256 of the whole text in UTF-8, null as empty."""
    return df.select(F.col(id_col).cast("long").alias("id"),
                     F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"))


def shards_for(rows: DataFrame) -> int:
    return max(MIN_SHARDS, -(-rows.select("digest").distinct().count() // SHARD_DIGESTS))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash, digests, winners and counts of its distinct digests."""
    return _groups(history, shards).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def merge(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of every digest of the index or the batch."""
    return (_groups(batch, shards).groupBy("shard").cogroup(index.groupBy("shard"))
            .applyInPandas(_merge_shard, "digest binary, keep_id long, group_size long")
            .withColumn("keep_id", F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))))


def exact_dedup(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Decide every row of ``batch`` and ``history`` (both from ``digest_rows``).

    Returns id, digest, keep_id, group_size, kept.
    """
    shards = shards_for(batch.union(history))
    groups = merge(batch, build_index(history, shards), shards)
    return (batch.union(history).join(groups, "digest")
            .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id"))))


def split_history(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch, history): rows of one table, halved by a hash of the id, as two deliveries."""
    old = F.pmod(F.xxhash64(F.coalesce("id", F.lit(0))), F.lit(2)) == 0
    return rows.where(~old), rows.where(old)


def dedup_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, digest, keep_id, group_size, kept."""
    rows = cut(digest_rows(df, id_col, text_col))
    return exact_dedup(*split_history(rows))

"""Removing repeated passages: a count-min prefilter, then exact grouping.

A window is a run of ``window`` consecutive words of one document. Every word
covered by a window whose word sequence also starts earlier (in a document
with a smaller id, or earlier in the same one) is removed.

Documents are dealt into blocks by a hash. Per block a count-min sketch with
``depth`` rows counts its windows; it is sent sparsely, as the sorted list of
its non-zero cells. The rows are cut into shards of cells, and all blocks'
sketches of a shard are merged in one task, so no sketch has to fit anywhere
whole, and the number of cells grows with the number of windows. Each block
gets back one bit a cell: counted twice or more. As a sketch never
underestimates, a window without that bit in every row occurs once.

The second pass groups exactly only the windows estimated repeated: each block
sends each such window once, as a 96-bit fingerprint with its smallest
document, to the shard of its fingerprint, and gets back whether a smaller
document in another block has it. A window in a third of all documents thus
costs one entry a block, not one a document.

The texts are shuffled into blocks once; all three passes read that exchange.

Defined cases: a null or empty text has no words and comes out empty; texts
shorter than a window stay as they are, but for white space, which becomes one
space between words; a null id sorts last; rows that repeat an id do not count
as earlier than each other; an empty table gives an empty result; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WordHashes, mix64

LAST_ID = 2**63 - 1


@dataclass(frozen=True)
class SubstringConfig:
    """Window length in words, sketch size, and how much a task holds."""
    window: int = 20
    depth: int = 2
    cells_per_window: int = 4
    block_bytes: int = 8 << 20
    shard_windows: int = 2_000_000


@dataclass(frozen=True)
class Layout:
    """Blocks, shards, and cells of a shard, from the size of the table."""
    config: SubstringConfig
    blocks: int
    shards: int
    cells: int


def plan_layout(df: DataFrame, text_col: str, c: SubstringConfig) -> Layout:
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(16, -(-size // (6 * c.shard_windows)))             # about six bytes a word
    return Layout(c, max(16, -(-size // c.block_bytes)), shards, c.cells_per_window * c.shard_windows)


_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd multiplier and of its inverse, modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) <= n:
        size = max(4096, 2 * n)
        out = []
        for base in (_M[which], pow(_M[which], -1, 2**64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[which] = out[0], out[1]
    up, down = _POWERS[which]
    return up[:n + 1], down[:n + 1]


def window_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of every window, from prefix sums."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(which, len(words))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix64(words + np.uint64(which)) * up[:len(words)], out=sums[1:])
    return mix64((sums[length:] - sums[:n]) * down[:n])


class Block:
    """The documents of a block in order of id, with their words and windows."""

    def __init__(self, table: pa.Table, c: SubstringConfig, second: bool = False):
        known = WordHashes()
        ids = [LAST_ID if i is None else i for i in table["id"].to_pylist()]
        texts = table["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids = np.array([ids[k] for k in order], dtype=np.int64)
        self.texts = [texts[k] for k in order]
        first, more, counts, self.n_words = [], [], [], []
        for t in self.texts:
            words = known.of(t.encode().split())
            self.n_words.append(len(words))
            first.append(window_hashes(words, c.window))
            counts.append(len(first[-1]))
            if second:
                more.append(window_hashes(words, c.window, 1))
        none = [np.zeros(0, dtype=np.uint64)]
        self.counts = np.array(counts, dtype=np.int64)
        self.hashes = np.concatenate(first or none)
        self.more = np.concatenate(more or none)
        self.doc = np.repeat(np.arange(len(self.texts)), self.counts)


def cells_of(hashes: np.ndarray, row: int, lay: Layout) -> np.ndarray:
    """Cell of each window in a row of the sketch, as shard * cells + cell in the shard."""
    h = mix64(hashes + np.uint64(0xA24BAED4963EE407 * (row + 1) % 2**64))
    shards, cells = np.uint64(lay.shards), np.uint64(lay.cells)
    return (h % shards) * cells + (h // shards) % cells


def pack_sorted(values: np.ndarray, universe: int) -> tuple[bytes, bytes]:
    """Sorted distinct numbers as low bytes and a bitmap of the unary-coded rest."""
    wide = len(values) and universe // len(values) > 1024
    shift, kind = (16, "<u2") if wide else (8, "u1")
    high = (values >> np.uint64(shift)).astype(np.int64) + np.arange(len(values))
    bits = np.zeros((high[-1] + 1) if len(high) else 0, dtype=bool)
    bits[high] = True
    return (values & np.uint64((1 << shift) - 1)).astype(kind).tobytes(), np.packbits(bits).tobytes()


def unpack_sorted(low: bytes, high: bytes, n: int) -> np.ndarray:
    wide = len(low) == 2 * n
    at = np.flatnonzero(np.unpackbits(np.frombuffer(high, dtype=np.uint8)))[:n] - np.arange(n)
    return (at << (16 if wide else 8)) | np.frombuffer(low, dtype="<u2" if wide else "u1").astype(np.int64)


def slices(keys: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of each shard's part of sorted keys."""
    shard = keys // np.uint64(size)
    starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(keys) else []
    ends = [*starts[1:], len(keys)] if len(keys) else []
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(starts, ends)]


SKETCH = "shard long, block long, n long, low binary, high binary, again binary"
MASKS = "block long, shard long, n long, mask binary"
EXACT = "shard long, block long, n long, first binary, second binary, docs binary, doc_at binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, type=types[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _bits(mask: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=n).astype(bool)


def sketch_block(table: pa.Table, lay: Layout) -> pa.Table:
    """The non-zero cells of the block's sketch, a row for each shard."""
    block, rows = table["block"][0].as_py(), []
    hashes = Block(table, lay.config).hashes
    for row in range(lay.config.depth):
        keys, count = np.unique(cells_of(hashes, row, lay), return_counts=True)
        for shard, a, b in slices(keys, lay.cells):
            low, high = pack_sorted(keys[a:b] - np.uint64(shard * lay.cells), lay.cells)
            rows.append((row * lay.shards + shard, block, b - a, low, high, np.packbits(count[a:b] > 1).tobytes()))
    return _table(rows, SKETCH)


def merge_sketches(table: pa.Table, lay: Layout) -> pa.Table:
    """Add all blocks' counts of a shard (up to 2); tell each block which of its cells have 2."""
    count = np.zeros(lay.cells, dtype=np.uint8)
    cells = []
    for r in table.select(["n", "low", "high", "again"]).to_pylist():
        at = unpack_sorted(r["low"], r["high"], r["n"])
        count[at] = np.minimum(count[at] + 1 + _bits(r["again"], r["n"]), 2)
        cells.append(at.astype(np.int32))
    shard = table["shard"][0].as_py()
    return _table([(block, shard, len(at), np.packbits(count[at] > 1).tobytes())
                   for block, at in zip(table["block"].to_pylist(), cells)], MASKS)


def shard_of(hashes: np.ndarray, lay: Layout) -> np.ndarray:
    """Shard of an exact fingerprint; it rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(lay.shards)) >> np.uint64(32)


def candidates(table: pa.Table, masks: pa.Table, lay: Layout) -> pa.Table:
    """The block's windows estimated repeated, each once, a row for each shard of fingerprints;
    and, under a shard of its own, one bit for each of the block's windows."""
    if not table.num_rows:
        return _table([], EXACT)
    number, b = table["block"][0].as_py(), Block(table, lay.config, second=True)
    repeated = np.ones(len(b.hashes), dtype=bool)
    by_shard = {r["shard"]: r for r in masks.to_pylist()}
    for row in range(lay.config.depth):
        keys, where = np.unique(cells_of(b.hashes, row, lay), return_inverse=True)
        marks = [_bits(by_shard[row * lay.shards + s]["mask"], hi - lo) for s, lo, hi in slices(keys, lay.cells)]
        if marks:
            repeated &= np.concatenate(marks)[where]
    at = np.flatnonzero(repeated)
    rows = [(-1 - number, number, len(repeated), np.packbits(repeated).tobytes(), b"", b"", b"")]
    hashes, first = np.unique(b.hashes[at], return_index=True)       # first: in the smallest document
    second = (b.more[at][first] >> np.uint64(32)).astype("<u4")
    ids = b.ids[b.doc[at][first]]
    for shard, lo, hi in slices(shard_of(hashes, lay), 1):
        docs, doc_at = np.unique(ids[lo:hi], return_inverse=True)
        rows.append((shard, number, hi - lo, hashes[lo:hi].tobytes(), second[lo:hi].tobytes(), docs.tobytes(),
                     doc_at.astype("<u2" if len(docs) <= 65536 else "<u4").tobytes()))
    return _table(rows, EXACT)


def find_earlier(table: pa.Table) -> pa.Table:
    """For every block's fingerprints of a shard, whether a smaller document in another block has it."""
    rows = table.to_pylist()
    if rows[0]["shard"] < 0:
        return _table([(r["block"], -1, r["n"], r["first"]) for r in rows], MASKS)
    first = np.concatenate([np.frombuffer(r["first"], dtype=np.uint64) for r in rows])
    second = np.concatenate([np.frombuffer(r["second"], dtype="<u4") for r in rows])
    docs = np.concatenate([np.frombuffer(r["docs"], dtype=np.int64)[
        np.frombuffer(r["doc_at"], dtype="<u2" if len(r["doc_at"]) == 2 * r["n"] else "<u4")] for r in rows])
    order = np.lexsort((docs, second, first))
    f, s, d = first[order], second[order], docs[order]
    starts = np.concatenate(([True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])))
    smallest = d[np.flatnonzero(starts)][np.cumsum(starts) - 1]
    earlier = np.zeros(len(order), dtype=bool)
    earlier[order] = smallest < d
    ends = np.cumsum([r["n"] for r in rows])
    return _table([(r["block"], r["shard"], r["n"], np.packbits(earlier[e - r["n"]:e]).tobytes())
                   for r, e in zip(rows, ends)], MASKS)


RESULT = "id long, n_words long, n_removed long, text string"


def remove_repeats(table: pa.Table, masks: pa.Table, lay: Layout) -> pa.Table:
    """Texts of the block's documents without the words of repeated windows."""
    if not table.num_rows:
        return _table([], RESULT)
    c, b = lay.config, Block(table, lay.config)
    by_shard = {r["shard"]: r for r in masks.to_pylist()}
    all_windows = by_shard.pop(-1)
    at = np.flatnonzero(_bits(all_windows["mask"], all_windows["n"]))
    hashes, first, which = np.unique(b.hashes[at], return_index=True, return_inverse=True)
    marks = [_bits(by_shard[s]["mask"], hi - lo) for s, lo, hi in slices(shard_of(hashes, lay), 1)]
    elsewhere = np.concatenate(marks) if marks else np.zeros(0, dtype=bool)
    ids = b.ids[b.doc[at]]
    smaller = ids > ids[first][which]                                 # a smaller document of this block has it
    # or it also starts earlier in the same document: not the first (document, window)
    order = np.lexsort((np.arange(len(at)), which, b.doc[at]))
    again = np.zeros(len(at), dtype=bool)
    o = order
    again[o[1:]] = (which[o[1:]] == which[o[:-1]]) & (b.doc[at][o[1:]] == b.doc[at][o[:-1]])
    gone = at[elsewhere[which] | smaller | again]

    first_window = np.concatenate(([0], np.cumsum(b.counts)))
    bounds = np.searchsorted(gone, first_window)
    rows = []
    for k, text in enumerate(b.texts):
        words, removed = text.encode().split(), 0
        starts = gone[bounds[k]:bounds[k + 1]] - first_window[k]
        if len(starts):
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + c.window, -1)
            keep = np.cumsum(cover[:-1]) == 0
            removed = int(len(words) - keep.sum())
            words = [w for w, stay in zip(words, keep.tolist()) if stay]
        rows.append((None if b.ids[k] == LAST_ID else int(b.ids[k]), b.n_words[k], removed, b" ".join(words).decode()))
    return _table(rows, RESULT)


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     config: SubstringConfig = SubstringConfig()) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, text (the kept words, one space between)."""
    lay = plan_layout(df, text_col, config)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(lay.blocks))).repartition(lay.blocks, "block")

    masks = (docs.groupBy("block").applyInArrow(lambda t: sketch_block(t, lay), SKETCH)
             .groupBy("shard").applyInArrow(lambda t: merge_sketches(t, lay), MASKS))
    exact = (docs.groupBy("block").cogroup(masks.groupBy("block"))
             .applyInArrow(lambda t, m: candidates(t, m, lay), EXACT)
             .groupBy("shard").applyInArrow(find_earlier, MASKS))
    return (docs.groupBy("block").cogroup(exact.groupBy("block"))
            .applyInArrow(lambda t, m: remove_repeats(t, m, lay), RESULT))

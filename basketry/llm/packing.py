"""Packing documents into sequences: order-preserving dynamic programming over cut points.

The documents of a partition, in their order, form one stream of tokens (each
document's ids, then the end id). It may be cut after a document (free),
after a sentence (a small penalty) or, inside long stretches without a
sentence end, after every few tokens (a larger penalty). The programme picks
the cuts that minimise padding plus penalties: with f(j) the cost of the
stream up to cut point j,

    f(j) = penalty(j) + min over i with pos(j) - window <= pos(i) < pos(j) of
           f(i) + (window - (pos(j) - pos(i)))

whose minimum of f(i) + pos(i) over a sliding range is kept in a monotone
queue, so a cut point costs amortised constant time. A sequence whose length
is a power of two is not padded; those (at most log2(window) + 1 a point)
are tried besides.

Nothing is shuffled: each task packs its own partition, holds one block of
tokens at a time and hands the last, still open sequences on to the next
block. Sequence ids carry the partition number, so they are unique.

Defined cases: null and empty texts give the end id alone; documents of any
length are cut; equal rows are packed each for itself; a null id is kept; an
empty table gives no pieces; other columns are ignored whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")
PIECE_ROWS = 128                # of up to 8 KB of ids, sent back at a time


@dataclass(frozen=True)
class PackConfig:
    """Window, costs in tokens, and how much is packed at a time."""
    window: int = 2048
    end_id: int = 1
    sentence_penalty: int = 8
    hard_penalty: int = 32
    sequence_cost: int = 8
    hard_gap: int = 64          # no stretch between cut points is longer than this
    block: int = 1 << 18        # tokens


class FileTokenizer:
    """Ids of a byte-level BPE tokenizer file (JSON), little-endian unsigned 32-bit.

    Where the file's ids follow its merges (checked), a rank-based encoder
    built from the same vocabulary gives the same ids several times faster;
    otherwise, and for a text on which that encoder gives up, the file's own
    tokenizer is used.
    """

    # the pre-tokenization pattern of byte-level BPE (fixed value)
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.slow = None
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        byte_of = {c: b for b, c in byte_characters().items()}
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
                 and not pre.get("add_prefix_space")
                 and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                             for t in spec.get("added_tokens", [])))
        in_order = all(vocab.get(m.replace(" ", "", 1)) == 256 + k for k, m in enumerate(merges))
        self.fast = None
        if plain and in_order:
            import tiktoken
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
            self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks,
                                          special_tokens=special)

    def encode(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except Exception:      # the pattern's backtracking limit, on megabytes of white space
                pass
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its token ends a sentence or holds a line feed."""
        feed = byte_characters()[10]
        return np.array([t.endswith((".", "!", "?")) or feed in t for t in self.tokens], dtype=bool)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others, in order, for
    the characters from U+0100 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, c: PackConfig) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, with 0 and its end, and their penalties."""
    n = len(ids)
    penalty = np.full(n + 1, -1, dtype=np.int64)
    penalty[1:][ends[np.minimum(ids, len(ends) - 1)]] = c.sentence_penalty
    penalty[doc_ends] = 0
    penalty[[0, n]] = 0
    points = np.flatnonzero(penalty >= 0)
    gaps = np.diff(points)
    step = c.hard_gap // 2
    for a, g in zip(points[:-1][gaps > c.hard_gap].tolist(), gaps[gaps > c.hard_gap].tolist()):
        penalty[a + step:a + g - step // 2:step] = c.hard_penalty
    points = np.flatnonzero(penalty >= 0)
    return points, penalty[points]


def choose_cuts(points: np.ndarray, penalty: np.ndarray, c: PackConfig) -> list[int]:
    """Positions of the chosen cuts, first and last point included, of least total cost."""
    n = len(points)
    # pairs (j, i) of points a power of two apart: sequences without padding
    later, earlier = [], []
    size = 1
    while size <= c.window:
        at = np.searchsorted(points, points - size)
        ok = np.flatnonzero((points >= size) & (points[at] == points - size))
        later.append(ok)
        earlier.append(at[ok])
        size *= 2
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    bounds = np.searchsorted(later[order], np.arange(n + 1)).tolist()
    exact = earlier[order].tolist()

    pos, pen = points.tolist(), (penalty + c.sequence_cost).tolist()
    cost, came = [0] * n, [0] * n
    queue, head, window = [0], 0, c.window
    for j in range(1, n):
        p = pos[j]
        while pos[queue[head]] < p - window:
            head += 1
        i = queue[head]
        best = cost[i] + pos[i] + window - p
        for k in exact[bounds[j]:bounds[j + 1]]:
            if cost[k] < best:
                best, i = cost[k], k
        best += pen[j]
        cost[j], came[j] = best, i
        value = best + p
        while len(queue) > head and cost[queue[-1]] + pos[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [pos[-1]], n - 1
    while j:
        j = came[j]
        cuts.append(pos[j])
    return cuts[::-1]


class Packer:
    """Packs one stream of documents; ``add`` and ``finish`` return finished pieces."""

    def __init__(self, ends: np.ndarray, c: PackConfig, first_sequence: int):
        self.ends, self.c, self.sequence = ends, c, first_sequence
        self.docs: list[tuple] = []      # (doc_id, tokens of the document, its ids from `start` on, start)
        self.held = 0

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        ids += np.array([self.c.end_id], dtype="<u4").tobytes()
        self.docs.append((doc_id, len(ids) // 4, ids, 0))
        self.held += len(ids) // 4
        return self._pack(last=False) if self.held >= self.c.block else []

    def finish(self) -> list[tuple]:
        return self._pack(last=True) if self.docs else []

    def _pack(self, last: bool) -> list[tuple]:
        raw = b"".join(d[2] for d in self.docs)
        ids = np.frombuffer(raw, dtype="<u4")
        doc_ends = np.cumsum([len(d[2]) // 4 for d in self.docs])
        cuts = choose_cuts(*cut_points(ids, doc_ends, self.ends, self.c), self.c)
        # sequences near the end of a block may change with what follows
        done = cuts if last else [x for x in cuts if x <= len(ids) - 2 * self.c.window]
        pieces, k = [], 0
        begin = [0, *doc_ends.tolist()]
        for a, b in zip(done, done[1:]):
            at = a
            while at < b:
                while begin[k + 1] <= at:
                    k += 1
                upto = min(b, begin[k + 1])
                doc_id, total, _, start = self.docs[k]
                pieces.append((doc_id, start + at - begin[k], upto - at, raw[4 * at:4 * upto], total,
                               self.sequence, at - a))
                at = upto
            self.sequence += 1
        if last:
            self.docs, self.held = [], 0
        else:
            at = done[-1]
            k = int(np.searchsorted(doc_ends, at, side="right"))
            doc_id, total, own, start = self.docs[k]
            skip = at - begin[k]
            self.docs = [(doc_id, total, own[4 * skip:], start + skip), *self.docs[k + 1:]]
            self.held = len(ids) - at
        return pieces


_TOKENIZERS: dict[str, tuple[FileTokenizer, np.ndarray]] = {}


def _tokenizer(path: str) -> tuple[FileTokenizer, np.ndarray]:
    if path not in _TOKENIZERS:
        t = FileTokenizer(path)
        _TOKENIZERS[path] = t, t.sentence_ends()
    return _TOKENIZERS[path]


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   config: PackConfig = PackConfig()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. ``tokenizer_path`` is a byte-level BPE file that every worker can read."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, ends = _tokenizer(tokenizer_path)
        packer = Packer(ends, config, TaskContext.get().partitionId() << 40)

        def rows(pieces):
            for at in range(0, len(pieces), PIECE_ROWS):
                cols = list(zip(*pieces[at:at + PIECE_ROWS]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, type=pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(cols)],
                    names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from rows(packer.add(doc_id, tokenizer.encode(text)))
        yield from rows(packer.finish())

    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(pack, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import _bytes, ensure_checkpoint_dir

# A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

ARROW_ROWS = 256
ARROW_BYTES = 4 << 20


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Send at most ``rows`` documents, and about ``size`` bytes, at a time to a Python worker.

    A batch is held whole on both sides; whole texts of tens of kilobytes
    would make Spark's defaults of 10,000 rows and 64 MB several hundred
    megabytes. Smaller limits that are already set stay.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key, "64m")) > size:
        spark.conf.set(key, f"{size}b")


def cut(df: DataFrame) -> DataFrame:
    """Compute a narrow or bounded table once, in the shared checkpoint folder.

    The files survive lost executors and are removed by Spark's context
    cleaner once no plan refers to them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class WordHashes(dict):
    """64-bit hashes of words (UTF-8 bytes), remembered up to ``limit`` words."""

    def __init__(self, limit: int = 60_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))

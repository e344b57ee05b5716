"""CSV files read in byte ranges although quoted values may hold line ends.

Where a record ends can't be told from a line alone: a line end is inside a
quoted value if the number of quotes before it is odd (RFC 4180 doubles quotes
inside values, which keeps that true). So the quotes of every block of every
file are counted first, the sums of the blocks before it give each block's
parity at its start, and then each block cuts its own records. A record that
crosses blocks comes out in fragments, at most two a block, which are put
together by a small aggregate. Lines, and thereby blocks, are what Spark's text
source splits files into; one number a block (128 MB by default) passes the
driver.

A quote inside an unquoted value breaks RFC 4180 and the count; such files need
``csv_scan(..., ranges=False)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "file long, owner long, block long, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def block_starts(lines: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Of every (file, block): whether it starts inside a quoted value (1 or 0), and in which block that record began."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    flips = lines.groupBy("file", "block").agg(F.count_if(quotes % 2 == 1).alias("n"))
    out: dict[tuple[int, int], tuple[int, int]] = {}
    before = None
    for file, block, n in sorted(tuple(r) for r in flips.collect()):        # one row a block
        if before is None or before[0] != file:
            start, owner = 0, block
        else:
            _, last, last_n = before
            start, owner = out[file, last]
            if not start or last_n:                 # the last block holds the start of the record it ends in
                owner = last
            start = (start + last_n) % 2
        out[file, block] = start, owner
        before = file, block, n
    return out


def cut_records(spark: SparkSession, lines: DataFrame, starts: dict[tuple[int, int], tuple[int, int]], whole: bool) -> DataFrame:
    """(file, owner, block, first, record): the whole records, or the fragments of those that cross blocks.

    Fragments are looked for in a pass of their own that only counts quotes and
    takes the text at the ends of blocks.
    """
    shared = spark.sparkContext.broadcast(starts)

    def rows(key: tuple[int, int], owner: int, first: bool, records: list[str]) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, x)) for x in (key[0], owner, key[1])]
            + [pa.array([first and k == 0 for k in range(n)], pa.bool_()), pa.array(records, pa.string())],
            names=["file", "owner", "block", "first", "record"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        key, odd, held, leading, first = None, 0, [], False, False
        for b in batches:
            file, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            changes = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
            bounds = [0, *changes.tolist(), len(file)]
            for i, j in zip(bounds, bounds[1:]):
                if i == j:
                    continue
                if (int(file[i]), int(block[i])) != key:
                    if held and not whole:                         # the last block ended inside a value
                        yield rows(key, start[key][1] if leading else key[1], first, ["\n".join(held)])
                    key, held = (int(file[i]), int(block[i])), []
                    odd = start[key][0]
                    leading, first = odd == 1, key[1] == 0
                lines_ = b.column(2).slice(i, j - i)
                after = (odd + np.cumsum(pc.count_substring(lines_, '"').to_numpy())) & 1
                ends = np.flatnonzero(after == 0).tolist()
                odd = int(after[-1])
                if not whole:
                    if ends and leading:
                        yield rows(key, start[key][1], first, ["\n".join([*held, *lines_[:ends[0] + 1].to_pylist()])])
                    if ends:
                        held, leading, first = [], False, False
                    held += lines_[ends[-1] + 1 if ends else 0:].to_pylist()
                    continue
                text = lines_.to_pylist()
                if not ends:
                    held += text
                    continue
                records = ["\n".join([*held, *text[:ends[0] + 1]])]
                records += [text[e] if e == s + 1 else "\n".join(text[s + 1:e + 1]) for s, e in zip(ends, ends[1:])]
                if leading:
                    del records[0]
                yield rows(key, key[1], first, records)
                held, leading, first = text[ends[-1] + 1:], False, False
        if held and not whole:
            yield rows(key, start[key][1] if leading else key[1], first, ["\n".join(held)])

    return lines.mapInArrow(cut, RECORDS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first): every record of the files; ``first`` marks the first of each file."""
    lines = _lines(spark, path)
    starts = block_starts(lines)
    whole = cut_records(spark, lines, starts, True).select("record", "first")
    joined = (cut_records(spark, lines, starts, False).groupBy("file", "owner")
              .agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "record")))["record"], "\n").alias("record"),
                   F.max("first").alias("first")))
    records = whole.union(joined.select("record", "first"))
    return records.select(F.rtrim("record", F.lit("\r")).alias("record"), "first")


def read_text_columns(spark: SparkSession, path: str, names: list[str], options: dict[str, str]) -> DataFrame:
    """The files' rows as text columns ``names`` (those of their headers, in order)."""
    records = read_records(spark, path).where(~F.col("first") & (F.col("record") != ""))
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    parsed = records.select(F.from_csv("record", F.lit(schema), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{k}").alias(n) for k, n in enumerate(names)])

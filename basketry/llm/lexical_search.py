"""Ranked lexical search: exact top documents of many items at once by NRA.

Documents are read once into narrow rows: number of terms, and the numbers and
frequencies of those terms that the items use. The corpus figures (documents,
all terms, documents a term) are plain aggregates over these rows. Every task
then takes its rows in shards of a bounded number of postings. In a shard each
term's postings are sorted by impact, and each item is answered by NRA (no
random access): the lists are read in step from the highest impact down; a
document's lower bound is the sum of the impacts read, its upper bound adds the
last impact read of every list in which it has not been met. Reading goes on
until the best documents are certain, their scores final and ties decided by
id. The shards' best are merged by windows, first within slices of the shards,
so an item's final ranking sees a bounded number of rows.

Scores are whole numbers. With N the documents with a term, L all their terms,
n a document's terms, df the documents with a term and tf its frequency:
weight w = floor(1000 ln((2N + 2) / (2df + 1))) in doubles,
m = 100 - b + (b n N) div L with b = 75 percent, and a document's score is the
sum of w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included.

What is broadcast is the items' vocabulary and weights. Items are taken in
batches of about ``batch_terms`` distinct terms, one pass a batch, so it stays
bounded however many items there are. No posting is shuffled or sent to the driver.

Defined cases: null and empty texts have no terms and are found by nothing;
items without terms, or whose terms occur nowhere, give no row; rows that repeat
an item's id and text are one item, the same id with another text is an item of
its own; rows that repeat a document's id are documents of their own; equal
scores go by ascending id, null last; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import cut

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# over UTF-8 bytes: letters and digits of ASCII (lower-cased) and all bytes beyond it stay, the rest separates
_TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()

MERGE_SLICES = 256                      # slices in which the shards' best of an item are merged first

ROWS_SCHEMA = "doc_id long, n long, terms array<int>, counts array<int>"
BEST_SCHEMA = "item long, doc_id long, score long"


@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    batch_terms: int = 200_000          # distinct terms of the items of one pass (broadcast, about 100 bytes each)
    shard_postings: int = 1_000_000     # postings that a task holds at a time (about 40 bytes each)
    first_depth: int = 128              # postings a list in the first round; every round doubles the depth


def terms_of(text: str | Column) -> Column:
    """The terms of a text, as an array."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_extract_all(F.translate(c, UPPER, LOWER), F.lit(TERM), 0)


def term_bytes(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def batches_of_items(items: DataFrame, batch_terms: int) -> list[DataFrame]:
    """(item, term, times) of the items, in batches of a bounded number of distinct terms.

    An item is kept whole: one item with more terms than the bound is a batch of its own.
    """
    rows = cut(items.select("item", F.explode(terms_of("text")).alias("term"))
               .groupBy("item", "term").agg(F.count(F.lit(1)).alias("times")))
    n = rows.count()
    if n <= batch_terms:
        return [rows] if n else []
    sizes = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # two-level running size: inside slices of items, then over the slices
    slices = -(-n // batch_terms)
    sliced = sizes.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(slices)))
    inside = Window.partitionBy("slice").orderBy("item")
    part = F.struct("slice", F.floor((F.sum("n").over(inside) - 1) / F.lit(batch_terms)).alias("part"))
    keyed = cut(sliced.select("item", part.alias("batch")))
    keys = [r["batch"] for r in keyed.select("batch").distinct().orderBy("batch").collect()]   # one row a batch
    return [rows.join(keyed.where((F.col("batch.slice") == k["slice"]) & (F.col("batch.part") == k["part"]))
                      .select("item"), "item") for k in keys]


def document_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per document with terms: doc_id, n, and the vocabulary's terms in it with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in batches:
            ids, n, offsets, terms, counts = [], [], [0], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = term_bytes(text or b"")
                if not words:
                    continue
                for term, times in Counter(words).items():
                    t = number.get(term)
                    if t is not None:
                        terms.append(t)
                        counts.append(times)
                ids.append(doc_id)
                n.append(len(words))
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))],
                names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(read, ROWS_SCHEMA)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, k: int, first_depth: int) -> list[tuple[int, int]]:
    """The best k (document, score) of impact-sorted lists [(documents, impacts)], by score, then ``order``.

    ``order`` ranks the documents (0 .. n-1) for ties. Sums stay exact in
    doubles: impacts are below 10^11 and lists below 10^4 in number.
    """
    n = len(order)
    lower = np.zeros(n)
    read, depth = 0, first_depth
    while True:
        fresh = [(docs[read:depth], impacts[read:depth]) for docs, impacts in lists if read < len(docs)]
        if fresh:
            lower += np.bincount(np.concatenate([d for d, _ in fresh]), np.concatenate([i for _, i in fresh]), n)
        # the most that an unread posting of each list can add, and what documents met in the list can't get of it
        open_ = [(docs[:depth], float(impacts[depth - 1])) for docs, impacts in lists if depth < len(docs)]
        last = [most for _, most in open_]
        met = (np.bincount(np.concatenate([d for d, _ in open_]), np.repeat(last, [len(d) for d, _ in open_]), n)
               if open_ else np.zeros(n))
        slack = sum(last) - met                           # upper bound - lower bound
        if not slack.any():
            best = np.flatnonzero(lower > 0)
            best = best[np.lexsort((order[best], -lower[best]))][:k]
            return [(int(d), int(lower[d])) for d in best]
        if np.count_nonzero(lower) >= k:
            edge = np.partition(lower, n - k)[n - k]      # the k-th lower bound
            live = np.flatnonzero(lower + slack >= edge)  # all others are certainly below
            if not slack[live].any():                     # final scores: the rest is a matter of sorting
                best = live[np.lexsort((order[live], -lower[live]))][:k]
                return [(int(d), int(lower[d])) for d in best]
        read, depth = depth, depth * 2


class Shard:
    """The postings of some documents, sorted by term and falling impact."""

    def __init__(self, ids: list[int | None], n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray,
                 docs_total: int, terms_total: int, weights: np.ndarray):
        self.ids = ids
        m = 25 + (75 * docs_total * n.astype(object) // terms_total).astype(np.int64) if len(n) else n
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
        tf = counts.astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        at = np.lexsort((-impact, terms))
        self.docs, self.impacts = doc[at], impact[at] * weights[terms[at]]
        self.first = np.searchsorted(terms[at], np.arange(len(weights) + 1))
        key = [(i is None, i or 0) for i in ids]
        self.order = np.empty(len(ids), dtype=np.int64)
        self.order[sorted(range(len(ids)), key=key.__getitem__)] = np.arange(len(ids))

    def best(self, item: list[tuple[int, int]], k: int, first_depth: int) -> list[tuple[int | None, int]]:
        lists = []
        for term, times in item:
            a, b = self.first[term], self.first[term + 1]
            if b > a and self.impacts[a] > 0:
                lists.append((self.docs[a:b], self.impacts[a:b] * times))
        return [(self.ids[d], score) for d, score in nra(lists, self.order, k, first_depth)] if lists else []


def search_shards(rows: DataFrame, items: dict[int, list[tuple[int, int]]], weights: list[int], docs_total: int,
                  terms_total: int, config: SearchConfig) -> DataFrame:
    """(item, doc_id, score): each shard's best documents of every item."""
    rows = rows.where(F.size("terms") > 0)
    shared = rows.sparkSession.sparkContext.broadcast((items, weights))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_item, w = shared.value
        w = np.array(w, dtype=np.int64)
        held: list[pa.RecordBatch] = []
        postings = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = [t.column(c).combine_chunks() for c in ("terms", "counts")]
            shard = Shard(t.column("doc_id").to_pylist(), t.column("n").to_numpy(),
                          lists[0].value_lengths().to_numpy(), *(x.flatten().to_numpy() for x in lists),
                          docs_total, terms_total, w)
            found = [(i, d, s) for i, terms in by_item.items() for d, s in shard.best(terms, config.k, config.first_depth)]
            cols = list(zip(*found)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score"])

        for b in batches:
            held.append(b)
            postings += len(b.column(2).flatten())
            if postings >= config.shard_postings:
                yield flush()
                held, postings = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(answer, BEST_SCHEMA)


def search_batch(docs: DataFrame, batch: DataFrame, id_col: str, text_col: str, config: SearchConfig) -> DataFrame:
    """(item, rank, doc_id, score) of one batch of items, given as (item, term, times)."""
    spark = docs.sparkSession
    wanted = batch.collect()                                      # at most batch_terms rows, or one item
    vocabulary = {t: k for k, t in enumerate(sorted({r["term"].encode() for r in wanted}))}
    items: dict[int, list[tuple[int, int]]] = {}
    for r in wanted:
        items.setdefault(r["item"], []).append((vocabulary[r["term"].encode()], r["times"]))

    rows = cut(document_terms(docs, id_col, text_col, vocabulary))
    total = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total["docs"] + 2.0) / (2.0 * F.col("df") + 1.0)))
    weights = [0] * len(vocabulary)
    for r in df.select("term", weight.alias("w")).collect():      # one row a term of the batch
        weights[r["term"]] = r["w"]

    best = search_shards(rows, items, weights, total["docs"], total["terms"], config)
    best = best.withColumn("slice", F.spark_partition_id() % MERGE_SLICES)
    by_score = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    for keys in (("item", "slice"), ("item",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by_score))
        best = best.withColumn("rank", place).where(F.col("rank") <= config.k)
    return best.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", config: SearchConfig = SearchConfig()) -> DataFrame:
    """The ``config.k`` best documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    own = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    own = cut(own.withColumn("item", F.monotonically_increasing_id()))
    found = [search_batch(docs, b, id_col, text_col, config)
             for b in batches_of_items(own, config.batch_terms)]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return (reduce(DataFrame.union, found).join(own.select("item", "item_id"), "item")
            .select("item_id", "rank", "doc_id", "score"))

"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``docs``. Texts stay where they are
read: a stage finds out from narrow rows which rows go, and the few that go
are looked up by (id, hash of the text). Each stage bounds the batches that
go to Python itself, as it may run outside ``corpus_pipeline.run``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import exact_dedup, mixing, near_dedup, packing, quality
from basketry.llm.common import bounded_batches, cut, text_or_empty

BROADCAST_ROWS = 200_000


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows of ``dropped`` (id, key).

    The dropped rows are broadcast if counting shows them few; beyond that the
    join is a shuffle on the id.
    """
    dropped = cut(dropped.select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct())
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs["doc_id"].eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_anti")


def once(docs: DataFrame, tied: DataFrame, key: Column) -> DataFrame:
    """``docs`` with one row of those that share an (id, key) of ``tied``: the smallest by its columns.

    Only those rows are grouped, map-side first, so many copies of one are few rows to shuffle.
    """
    tied = cut(tied.select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct())
    n = tied.count()
    if n == 0:
        return docs
    if n <= BROADCAST_ROWS:
        tied = F.broadcast(tied)
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (key == F.col("__key"))
    one = (docs.join(tied, same).groupBy("__id", "__key").agg(F.min(F.struct(*docs.columns)).alias("__row"))
           .select("__row.*"))
    return docs.join(tied, same, "left_anti").unionByName(one)


@bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are probably bad by the rules' votes go."""
    return quality.filter_documents(docs)


@bounded
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts only one row stays, of the document with the largest id."""
    seen = exact_dedup.dedup_documents(docs).groupBy("id", F.col("digest").alias("key"), "kept").agg(
        F.count(F.lit(1)).alias("n"))
    several = cut(seen.where("not kept or n > 1"))
    key = F.unhex(F.sha2(text_or_empty("text"), 256))
    return once(without(docs, several.where("not kept"), key), several.where("kept"), key)


@bounded
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays, of the document with the smallest id.

    Of several texts under that id, or without any id, the one with the smallest hash stays.
    """
    seen = cut(near_dedup.near_groups(docs).where("root is not null")
               .groupBy("root", "id", F.col("text_key").alias("key"), "kept").agg(F.count(F.lit(1)).alias("n")))
    best = seen.where("kept").groupBy("root").agg(F.min("key").alias("best"))
    seen = seen.join(best, "root").withColumn("stays", F.col("kept") & (F.col("key") == F.col("best")))
    key = F.xxhash64(text_or_empty("text"))
    return once(without(docs, seen.where("not stays"), key), seen.where("stays and n > 1"), key)


@bounded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources reach their target weights."""
    return mixing.mix_documents(docs)


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, as in the packing query."""
    return packing.piece_digests(packing.pack_documents(docs, tokenizer_path()))

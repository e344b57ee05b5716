"""One query per operator, over its whole table: ``QUERIES[name](spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (chat_format, exact_dedup, langid, lexical_search, license_scan, mixing, near_dedup, packing, pii,
                          prefix_trie, quality, substring_dedup, warc)
from basketry.llm.common import bounded_batches
from basketry.llm.stages import tokenizer_path
from basketry.session import scratch_path
from basketry.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@query
def op1_mix(spark, sf_dir):
    """Words each document gives to a mix of 150% of all words, sources weighing 3, 1, 2."""
    out = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op2_quality(spark, sf_dir):
    """Every document's quality figures, base rule and verdict by weak supervision."""
    out = quality.judge(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "quality")


@query
def op3_near_dedup(spark, sf_dir):
    """Every document with the component of documents linked by 2-word shingles."""
    out = near_dedup.near_groups(read_table(spark, sf_dir, "documents"), config=near_dedup.NearConfig(shingle=2))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op4_langid(spark, sf_dir):
    """The language of every document, learnt from those whose crc32(doc_id) mod 4 is not 2."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    filters = langid.train(docs.where(~held_out))
    out = langid.predict(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", held_out.alias("held_out"), F.col("prediction.lang").alias("lang_pred"),
                      F.col("prediction.score").alias("score"))


@query
def op5_pack(spark, sf_dir):
    """Every document's tokens in sequences of at most 2048."""
    return packing.piece_digests(packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path()))


@query
def op6_substring_dedup(spark, sf_dir):
    """Every document without the words of 20-word windows that start earlier in the corpus."""
    out = substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                      F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_pii(spark, sf_dir):
    """Every document's text with personal data pseudonymised, and how many values of each kind it held."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, key="corpus-key-1")
    kinds = F.col("pii_kinds")
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", F.size(kinds).cast("long").alias("n_values"), *count, "text")


@query
def op8_license_scan(spark, sf_dir):
    """License labels of every document, by phrase and by containment of notices."""
    out = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), block_separator=None)
    return out.withColumnRenamed("id", "doc_id")


@query
def op9_warc(spark, sf_dir):
    """Every page's record as read back from the archives, in order of URL key and capture time."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    # the table has no capture time: one second a page from a fixed start
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    pages = pages.withColumn("captured_at", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    out = warc.archive_pages(spark, pages, scratch_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_exact_dedup(spark, sf_dir):
    """Every document with its group of equal texts and the one that stays."""
    out = exact_dedup.dedup_documents(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


CONTROL_CHAT = "</s>[INST] ok [/INST]"      # fixed value: both turns of conversation -7


@query
def op11_chat_format(spark, sf_dir):
    """Every conversation and one of control strings, formatted, and its turns and learnt texts read back."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(CONTROL_CHAT).alias("text"))
    chats = chat_format.format_chats(turns.unionByName(control))
    read = chats.select("conv_id", chat_format.read_turns(F.col("text")).alias("turns"),
                        F.array_join(chat_format.read_loss(F.col("text"), F.col("loss")), "").alias("learnt"),
                        F.char_length("text").cast("long").alias("formatted_chars"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                       F.char_length("learnt").cast("long").alias("loss_chars"),
                       F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


@query
def op12_prefix_trie(spark, sf_dir):
    """Every distinct prefix of the conversations, rebuilt to share their first turns."""
    numbered = prefix_trie.number_turns(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.build_trie(*prefix_trie.share_heads(numbered))


@query
def op13_ranked_search(spark, sf_dir):
    """Every benchmark item's ten best documents."""
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

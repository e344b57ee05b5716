"""License scans: base phrases by position, and an exact containment join with templates.

Base labels are found where a phrase's words stand consecutively. The method
adds labels by an exact set-similarity join: a block matches a template if it
holds at least ``threshold`` of the template's distinct words. A block is a
part between separators (a line by default) or, with ``block_separator`` None,
any run of consecutive words across line breaks that is at most 1 / threshold
times as long as the template, so a notice may be wrapped and the words of a
long line must stand together. Words are ordered by their frequency over all documents,
rarest first. A matching block must hold a word of the template's prefix (its
first n - ceil(threshold * n) + 1 words), must be long enough (length filter)
and, from the first common word on, both sides must have enough words left
(positional filter); what passes is counted exactly. No match is missed. Runs
are made only around the places of prefix words, of documents that hold enough
words of a template, and count the words from the prefix word on in that order.

Templates of related licenses differ by a word or two, so one notice can meet the
threshold of several. Without separators a match is a place: a run of words whose
first is a template word that it holds once, cut after the last word that adds to
the match. Of matches of different labels that overlap, the one that holds less of
its template goes and, where they hold the same share, the one of the shorter template;
equals all stay. So a notice gets the label of its closest template, and templates that
stand apart in a text each get theirs. Words are sets: a notice's words in
another order match as well. Matches meet in cells of as many words as the longest
run, so no text is compared with itself as a whole.

All of it is DataFrame expressions. A document's text is read once: only its
blocks' template words, a few strings, go on. The templates are a parameter;
the prefix index made of them is broadcast below a stated number of rows and
joined by shuffle above it. Blocks that share words are never paired with one
another, only with templates.

Defined cases: a null text counts as empty and has no words and no labels;
text without a match gets empty label strings, null positions and score 0;
rows that repeat an id are scanned each for itself; an empty table gives an
empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import cut, text_or_empty

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_PREFIXES = 100_000

# Phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short notices of common licenses and their labels (fixed values).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License"),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General "
             "Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Affero General Public License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]       # distinct
    needed: int                  # ceil(threshold * number of words)
    window: int                  # most words of a run: ceil(number of words, with repeats / threshold)


def template_words(text: str) -> list[str]:
    import re
    return re.findall(LICENSE_WORD, text.translate(str.maketrans(UPPER, LOWER)))


def make_templates(texts: list[tuple[str, str]], threshold: float) -> list[Template]:
    """Templates with the number of words that a block must hold of each."""
    out = []
    for label, text in texts:
        every = template_words(text)
        words = tuple(dict.fromkeys(every))
        if words:
            out.append(Template(label, words, math.ceil(threshold * len(words) - 1e-9),
                                math.ceil(len(every) / threshold - 1e-9)))
    return out


def lowered(text: str | Column) -> Column:
    return F.translate(text_or_empty(text), UPPER, LOWER)


def phrase_starts(lower: Column, words: Column, phrase: str) -> Column:
    """Word positions at which the phrase's words stand one after another."""
    parts = phrase.split()
    here = None
    for p in parts:
        here = F.contains(lower, F.lit(p)) if here is None else here & F.contains(lower, F.lit(p))

    def at(i):
        ok = None
        for k, p in enumerate(parts):
            test = F.get(words, i + k) == p
            ok = test if ok is None else ok & test
        return ok

    none = F.array().cast("array<int>")
    long_enough = F.size(words) >= len(parts)
    return F.when(here & long_enough,
                  F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), at)).otherwise(none)


def literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def scan(df: DataFrame, templates: list[Template], id_col: str, text_col: str,
         block_separator: str | None) -> DataFrame:
    """One narrow row per document: base places, and of each long enough block its template words.

    Without a separator ``hits`` has the template words (at, word) of documents
    that hold enough words of some template, in the place of blocks.
    """
    vocabulary = literals(sorted({w for t in templates for w in t.words}))
    if block_separator is None:
        return scan_runs(df, templates, id_col, text_col, vocabulary)
    least = min((t.needed for t in templates), default=1)
    lines = (df.select(F.col(id_col).alias("id"), lowered(text_col).alias("lower"))
             .withColumn("block_words", F.transform(F.split("lower", block_separator),
                                                    lambda b: F.regexp_extract_all(b, F.lit(LICENSE_WORD), F.lit(0))))
             .withColumn("words", F.flatten("block_words")))
    hits = F.transform("block_words", lambda b: F.array_intersect(b, vocabulary)) if templates else \
        F.array().cast("array<array<string>>")
    out = lines.select("id", F.size("words").cast("long").alias("n_words"),
                       *[phrase_starts(F.col("lower"), F.col("words"), p).alias(f"at_{k}")
                         for k, p in enumerate(PHRASES)], hits.alias("hits"))
    return out.select("id", "n_words", *[f"at_{k}" for k in range(len(PHRASES))],
                      F.array_distinct(F.flatten("hits")).alias("seen"),
                      F.filter("hits", lambda h: F.size(h) >= least).alias("blocks"))


def scan_runs(df: DataFrame, templates: list[Template], id_col: str, text_col: str, vocabulary: Column) -> DataFrame:
    texts = (df.select(F.col(id_col).alias("id"), lowered(text_col).alias("lower"))
             .withColumn("words", F.regexp_extract_all("lower", F.lit(LICENSE_WORD), F.lit(0))))
    seen = F.array_intersect("words", vocabulary) if templates else F.array().cast("array<string>")
    out = texts.select("id", "words", F.size("words").cast("long").alias("n_words"),
                       *[phrase_starts(F.col("lower"), F.col("words"), p).alias(f"at_{k}")
                         for k, p in enumerate(PHRASES)], seen.alias("seen"))
    hits = F.array().cast("array<struct<at:int,word:string>>")
    if templates:
        sizes = F.array(*[F.struct(literals(t.words).alias("words"), F.lit(t.needed).alias("needed")) for t in templates])
        enough = F.exists(sizes, lambda t: F.size(F.array_intersect(F.col("seen"), t["words"])) >= t["needed"])
        places = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
        hits = F.when(enough, F.filter(places, lambda h: F.array_contains(vocabulary, h["word"]))).otherwise(hits)
    return out.select("id", "n_words", *[f"at_{k}" for k in range(len(PHRASES))], "seen", hits.alias("hits"))


def frequency_order(rows: DataFrame, templates: list[Template]) -> dict[str, int]:
    """Position of every template word in the global order, rarest first (documents that hold it)."""
    counts = {r["word"]: r["n"] for r in rows.select(F.explode("seen").alias("word")).groupBy("word")
              .agg(F.count(F.lit(1)).alias("n")).collect()}        # at most one row per template word
    words = {w for t in templates for w in t.words}
    return {w: k for k, w in enumerate(sorted(words, key=lambda w: (counts.get(w, 0), w)))}


def containment_join(blocks: DataFrame, templates: list[Template], order: dict[str, int]) -> DataFrame:
    """(row, label, score) of every block and template that meet the threshold.

    ``blocks`` has ``row`` and ``words``, the block's distinct template words.
    """
    spark = blocks.sparkSession
    prefixes, bodies = [], []
    for t, template in enumerate(templates):
        ordered = sorted(template.words, key=order.__getitem__)
        for p, w in enumerate(ordered[:len(ordered) - template.needed + 1]):
            prefixes.append((w, t, p, len(ordered), template.needed))
        bodies.append((t, template.label, ordered))
    index = spark.createDataFrame(prefixes, "word string, template int, position int, length int, needed int")
    texts = spark.createDataFrame(bodies, "template int, label string, template_words array<string>")
    if len(prefixes) <= BROADCAST_PREFIXES:
        index, texts = F.broadcast(index), F.broadcast(texts)

    rank = F.create_map(*[F.lit(x) for w, k in order.items() for x in (w, k)])
    in_order = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(rank[w].alias("rank"), w.alias("word")))),
                           lambda s: s["word"])
    words = blocks.withColumn("words", in_order).withColumn("block", F.monotonically_increasing_id())
    probes = words.select("row", "words", "block", F.posexplode("words").alias("at", "word"))
    candidates = (probes.join(index, "word")
                  .where((F.size("words") >= F.col("needed"))                                     # length
                         & (F.col("length") - F.col("position") >= F.col("needed"))               # positions
                         & (F.size("words") - F.col("at") >= F.col("needed"))))
    # a block meets a template once, at their first common word
    first = candidates.groupBy("row", "block", "template").agg(
        F.first("words").alias("words"), F.first("needed").alias("needed"), F.first("length").alias("length"))
    common = F.size(F.array_intersect("words", "template_words"))
    return (first.join(texts, "template").withColumn("common", common)
            .where(F.col("common") >= F.col("needed"))
            .select("row", "label", (F.col("common") / F.col("length")).alias("score")))


def runs_join(rows: DataFrame, templates: list[Template], order: dict[str, int]) -> DataFrame:
    """(row, label, length, common, lo, hi) of every place of words lo to hi that meets a template's threshold.

    ``rows`` has ``row`` and ``hits``, the document's template words by place.
    """
    spark = rows.sparkSession
    prefixes = []
    for template in templates:
        ordered = sorted(template.words, key=order.__getitem__)
        prefixes += [(w, template.label, len(ordered), template.needed, template.window, ordered, ordered[p:])
                     for p, w in enumerate(ordered[:len(ordered) - template.needed + 1])]
    index = spark.createDataFrame(
        prefixes, "word string, label string, length int, needed int, window int, template_words array<string>, "
                  "rest array<string>")
    if len(prefixes) <= BROADCAST_PREFIXES:
        index = F.broadcast(index)

    # around each prefix word the hits that any run through it can reach
    reach = max(t.window for t in templates) - 1
    starters = literals(sorted({p[0] for p in prefixes}))
    places = F.filter(F.sequence(F.lit(0), F.size("hits") - 1),
                      lambda j: F.array_contains(starters, F.get("hits", j)["word"]))
    probe = F.transform(places, lambda j: F.struct(
        F.get("hits", j)["at"].alias("at"), F.get("hits", j)["word"].alias("word"),
        F.slice("hits", F.greatest(j + 1 - reach, F.lit(1)), F.lit(2 * reach + 1)).alias("near")))
    probes = rows.where(F.size("hits") > 0).select("row", F.explode(probe).alias("p")).select("row", "p.*")

    def distinct(hits):
        return F.array_distinct(F.transform(hits, lambda h: h["word"]))

    # a match has its rarest common word in the prefix, and the others come later in the order
    candidates = (probes.join(index, "word")
                  .withColumn("near", F.filter("near", lambda h: F.abs(h["at"] - F.col("at")) < F.col("window")))
                  .where(F.size(distinct(F.filter("near", lambda h: F.array_contains(F.col("rest"), h["word"]))))
                         >= F.col("needed"))
                  .withColumn("near", F.filter("near", lambda h: F.array_contains(F.col("template_words"), h["word"]))))
    # runs begin at hits; of each the places of the first of every word
    runs = F.transform(
        F.filter("near", lambda s: s["at"] <= F.col("at")),
        lambda s: F.filter("near", lambda h: h["at"].between(s["at"], s["at"] + F.col("window") - 1)))
    found = candidates.select("row", "label", "length", "needed", F.explode(runs).alias("run")).withColumn(
        "firsts", F.transform(distinct(F.col("run")), lambda w: F.array_min(
            F.transform(F.filter("run", lambda h: h["word"] == w), lambda h: h["at"]))))
    found = found.select("row", "label", "length", "needed", F.size("firsts").alias("common"),
                         F.get("run", F.lit(0))["at"].alias("lo"), F.array_max("firsts").alias("hi"),
                         F.get("run", F.lit(0))["word"].alias("head"), "run").where("common >= needed")
    once = F.size(F.filter("run", lambda h: (h["word"] == F.col("head")) & (h["at"] <= F.col("hi")))) == 1
    return found.where(once).select("row", "label", "length", "common", "lo", "hi").distinct()


def closest(matches: DataFrame, cell: int) -> DataFrame:
    """(row, label, score) of the matches that no overlapping one of another label beats; none is longer than ``cell``."""
    cells = matches.select("row", "label", "length", "common", "lo", "hi",
                           F.explode(F.sequence((F.col("lo") / cell).cast("int"), (F.col("hi") / cell).cast("int"))).alias("cell"))
    fields = ["label", "length", "common", "lo", "hi"]
    # a cell holds at most one match a place and template
    met = cells.groupBy("row", "cell").agg(F.collect_list(F.struct(*fields)).alias("all"))

    def beats(o, m):
        share = o["common"] * m["length"] - m["common"] * o["length"]
        return ((o["label"] != m["label"]) & (o["lo"] <= m["hi"]) & (o["hi"] >= m["lo"])
                & ((share > 0) | ((share == 0) & (o["length"] > m["length"]))))

    judged = F.transform("all", lambda m: F.struct(*[m[f].alias(f) for f in fields],
                                                   F.exists("all", lambda o: beats(o, m)).alias("beaten")))
    return (met.select("row", F.inline(judged)).groupBy("row", *fields).agg(F.max("beaten").alias("beaten"))
            .where("not beaten").select("row", "label", (F.col("common") / F.col("length")).alias("score")))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.9,
                  block_separator: str | None = "\n") -> DataFrame:
    """One row per row of ``df``: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    made = make_templates(templates, threshold)
    rows = cut(scan(df, made, id_col, text_col, block_separator).withColumn("row", F.monotonically_increasing_id()))
    places = F.concat(*[F.col(f"at_{k}") for k in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label))
                                     for k, label in enumerate(PHRASES.values())]))
    out = rows.select("row", "id", "n_words", F.size(places).cast("long").alias("n_base"),
                      F.array_min(places).cast("long").alias("first_word"),
                      F.array_max(places).cast("long").alias("last_word"),
                      F.array_sort(F.array_distinct(base)).alias("base"))
    if made:
        order = frequency_order(rows, made)
        if block_separator is None:
            matches = closest(runs_join(rows, made, order), max(t.window for t in made))
        else:
            matches = containment_join(rows.select("row", F.explode("blocks").alias("words")), made, order)
        found = matches.groupBy("row").agg(
            F.collect_set("label").alias("more"), F.max("score").alias("found_score"))
        out = out.join(found, "row", "left")
    else:
        out = out.withColumn("more", F.lit(None).cast("array<string>")).withColumn("found_score", F.lit(None).cast("double"))
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("id", "n_words", "n_base", "first_word", "last_word",
                      F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                      F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("found_score", F.lit(0.0))).alias("score"))

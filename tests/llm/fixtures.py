"""A small table of awkward documents, with other columns whose names collide with the operators' own."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, size long, "
          "hash string, digest string, node long, n long, keys string, block long, words string, row string, "
          "rank long, target double, quality string, label string, at long, bucket long, root long")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)


def awkward_texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): null, empty and white-space texts, copies, near copies, ties, long texts."""
    rng = random.Random(7)
    base = prose(rng, 300)
    near = base.split()
    near[150] = "changed"
    passage = prose(rng, 60)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", None), (4, "one", "b"), (5, "one two", "b"),
        (6, "One TWO", "b"), (7, " nbsp is no separator ÉA", "c"), (8, base, "a"), (9, base, "c"),
        (10, " ".join(near), "a"), (11, base + " tail", None), (12, prose(rng, 80) + "\n" + passage, "b"),
        (13, passage + "\n\n" + prose(rng, 90), "b"), (14, prose(rng, 40) + " " + passage, "a"),
        (15, " ".join(["same"] * 70), "a"), (16, "x" * 50_000, "c"), (17, prose(rng, 20_000, 5000), "a"),
        (18, "a b c a b c a b c a b", "b"), (18, "a b c a b c a b c a b", "b"), (19, base, "c"),
        (20, "line\nline\n\n \nline two", "c"), (21, "### *** $$$ a|b <x> & y%", "a"), (22, "\U0001F600 \U0001F600 ok", "a"),
        (None, "a text without id " + passage, "a"), (2**62, "large id", "z"), (-5, "negative id", "é"),
    ]
    rows += [(100 + k, prose(rng, rng.randrange(1, 200)), rng.choice("abc")) for k in range(40)]
    rows += [(200 + k, base, "a") for k in range(25)]
    return rows


def awkward(spark, partitions: int = 3):
    rows = [(i, t, None, s, 0, 1, True, 2, "h", "d", 3, 4, "k", 5, "w", "r", 6, 0.5, "q", "l", 7, 8, 9)
            for i, t, s in awkward_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_only(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")

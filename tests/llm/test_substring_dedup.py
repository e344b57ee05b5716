import random
import re
from collections import defaultdict

import numpy as np

from basketry.llm import substring_dedup as sd
from tests.llm.fixtures import awkward, awkward_texts, empty, prose, texts_only

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    last = 2**63 - 1
    words = [WORD.findall(t or "") for _, t, _ in rows]
    first = {}
    starts = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        for s in range(len(words[k]) - window + 1):
            w = tuple(words[k][s:s + window])
            i2 = last if i is None else i
            first[w] = min(first.get(w, i2), i2)
            starts[(w, k)].append(s)
    gone = defaultdict(set)
    for (w, k), at in starts.items():
        i = last if rows[k][0] is None else rows[k][0]
        for s in at:
            if first[w] < i or s > at[0]:
                gone[k].update(range(s, s + window))
    return sorted((str(rows[k][0]), len(words[k]), len(gone[k]),
                   " ".join(w for at, w in enumerate(words[k]) if at not in gone[k])) for k in range(len(rows)))


def got(df, **config):
    return sorted((str(r["id"]), r["n_words"], r["n_removed"], r["text"])
                  for r in sd.dedup_substrings(df, config=sd.SubstringConfig(**config)).collect())


def test_awkward_documents_equal_brute_force(spark):
    assert got(awkward(spark)) == brute(awkward_texts())


def test_small_blocks_shards_and_sketches_equal_brute_force(spark):
    rng = random.Random(8)
    passages = [prose(rng, 30) for _ in range(6)]
    rows = [(k, " ".join(rng.choice([prose(rng, rng.randrange(1, 40)), rng.choice(passages)]) for _ in range(5)), "a")
            for k in range(250)]
    df = texts_only(spark, rows).repartition(6)
    assert got(df, block_bytes=4000, shard_windows=500) == brute(rows)
    # a sketch so small that nearly every window is estimated repeated loses and adds nothing
    assert got(df, block_bytes=4000, shard_windows=500, cells_per_window=1, depth=1) == brute(rows)


def test_packed_cells_round_trip():
    rng = np.random.default_rng(6)
    for universe, n in ((1000, 0), (1000, 1), (1000, 700), (8_000_000, 50), (8_000_000, 300_000)):
        v = np.sort(rng.choice(universe, n, replace=False)).astype(np.uint64)
        low, high = sd.pack_sorted(v, universe)
        assert (sd.unpack_sorted(low, high, n) == v.astype(np.int64)).all()


def test_window_hashes_depend_on_every_word():
    words = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = np.concatenate((words, words))
    h = sd.window_hashes(twice, 20)
    assert (h[:40] == h[59:99]).all() and len(set(h.tolist())) == 59


def test_empty(spark):
    assert sd.dedup_substrings(empty(spark)).count() == 0

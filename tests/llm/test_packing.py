import random
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from basketry.llm import packing
from basketry.llm.stages import tokenizer_path
from tests.llm.fixtures import awkward, awkward_texts, empty


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizer_file(reference):
    fast = packing.FileTokenizer(tokenizer_path())
    assert fast.fast is not None
    rng = random.Random(5)
    alphabet = list("ab AB12.,!?'\n\t\r\x0b\x1c  é漢\U0001F600  ्") + [" the", "'ll", "<|endoftext|>", "  "]
    texts = ["", " ", "\n\n a", "it's <|endoftext|> x"] + [
        "".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(400)]
    texts += [t or "" for _, t, _ in awkward_texts()]
    for t in texts:
        want = reference.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == want, t


def test_round_trip_and_limits(spark, reference):
    pieces = packing.pack_documents(awkward(spark), tokenizer_path()).collect()
    want = defaultdict(list)
    for i, t, _ in awkward_texts():
        want[i].append([*reference.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        by_doc[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, texts in want.items():
        got = []
        for start, ids, total in sorted(by_doc[i], key=lambda x: x[0]):
            if start == 0:
                got.append([])
            if len(texts) == 1:
                assert start == len(got[-1]) and total == len(texts[0])
            got[-1] += ids
        assert sorted(map(len, got)) == sorted(map(len, texts)) and sorted(got) == sorted(texts)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_little_padding_on_many_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [r["n"] for r in packing.pack_documents(docs, tokenizer_path()).groupBy("sequence_id")
             .agg(packing.F.sum("length").alias("n")).collect()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding < 0.02 * sum(sizes)


def brute_cost(points, penalty, c):
    @lru_cache(None)
    def f(j):
        if j == 0:
            return 0
        best = min(f(i) + (0 if (n := points[j] - points[i]) & (n - 1) == 0 else c.window - n)
                   for i in range(j) if points[j] - points[i] <= c.window)
        return best + penalty[j] + c.sequence_cost
    return f(len(points) - 1)


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        c = packing.PackConfig(window=int(rng.choice([16, 32, 64])), hard_gap=8)
        gaps = rng.integers(1, 9, rng.integers(1, 60))
        points = np.concatenate(([0], np.cumsum(gaps)))
        penalty = rng.choice([0, 8, 32], len(points))
        penalty[[0, -1]] = 0
        cuts = packing.choose_cuts(points, penalty, c)
        at = {int(p): k for k, p in enumerate(points)}
        cost = 0
        for a, b in zip(cuts, cuts[1:]):
            n = b - a
            assert 0 < n <= c.window
            cost += (0 if n & (n - 1) == 0 else c.window - n) + int(penalty[at[b]]) + c.sequence_cost
        assert cost == brute_cost(tuple(points.tolist()), tuple(penalty.tolist()), c)


def test_small_blocks_lose_nothing():
    c = packing.PackConfig(window=64, block=300, hard_gap=16)
    ends = np.zeros(100, bool)
    ends[7] = True
    rng = np.random.default_rng(4)
    packer, docs, pieces = packing.Packer(ends, c, 0), [], []
    for k in range(200):
        docs.append(rng.integers(0, 100, rng.integers(0, 150)).astype("<u4"))
        pieces += packer.add(k, docs[-1].tobytes())
    pieces += packer.finish()
    for k, d in enumerate(docs):
        own = [p for p in pieces if p[0] == k]
        assert b"".join(p[3] for p in own) == d.tobytes() + np.array([1], "<u4").tobytes()
        assert [p[1] for p in own] == np.cumsum([0] + [p[2] for p in own])[:-1].tolist()


def test_empty(spark):
    assert packing.pack_documents(empty(spark), tokenizer_path()).count() == 0

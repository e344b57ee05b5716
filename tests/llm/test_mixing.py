import re
from collections import defaultdict
from fractions import Fraction

from basketry.llm import mixing
from tests.llm.fixtures import awkward, awkward_texts, empty, texts_only

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), budget=Fraction(3, 2), cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = Fraction(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def check(spark, rows, out):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = brute_targets(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - float(target[r["source"]])) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["times"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - float(target[s])) <= largest[s] / 2 + 1e-6


def test_targets_and_taken_words(spark):
    check(spark, awkward_texts(), mixing.mix_sources(awkward(spark)))


def test_many_small_sources_and_one_hot(spark):
    rows = [(k, "w " * (k % 7), "hot" if k % 3 == 0 else f"s{k % 41}") for k in range(3000)]
    check(spark, rows, mixing.mix_sources(texts_only(spark, rows)))


def test_reruns_and_partitions_agree(spark):
    a = {tuple(r) for r in mixing.mix_sources(awkward(spark, 2)).select("id", "size", "taken").collect()}
    b = {tuple(r) for r in mixing.mix_sources(awkward(spark, 5)).select("id", "size", "taken").collect()}
    assert a == b


def test_documents_are_emitted_as_often_as_taken(spark):
    docs = awkward(spark)
    want = sorted((r["id"] or 0, r["size"], r["times"]) for r in mixing.mix_sources(docs).collect())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[(r["doc_id"] or 0, len(WORD.findall(r["text"] or "")))] += 1
    expected = defaultdict(int)
    for i, size, times in want:
        expected[(i, size)] += times
    assert {k: v for k, v in expected.items() if v} == dict(counts)


def test_empty_and_wordless(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    rows = [(1, None, "a"), (2, "", None)]
    assert all(r["target"] == 0 and r["taken"] == 0 for r in mixing.mix_sources(texts_only(spark, rows)).collect())

import re
from collections import Counter

import numpy as np

from basketry.llm import quality
from tests.llm.fixtures import awkward, awkward_texts, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for d in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_base_figures_equal_brute_force(spark):
    got = sorted(tuple(r) for r in quality.judge(awkward(spark)).selectExpr(
        "coalesce(id, -1)", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for i, t, _ in awkward_texts():
        f = brute(t)
        want.append((-1 if i is None else i, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]))
    assert got == sorted(want)


def test_verdict_against_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "truth")
    judged = quality.judge(docs)
    rows = judged.join(labels, judged["id"] == labels["doc_id"]).where("not base_failed").collect()
    assert rows
    good = [r for r in rows if r["truth"] == 1]
    bad = [r for r in rows if r["truth"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def test_em_recovers_rule_accuracies():
    rng = np.random.default_rng(3)
    n, acc = 20_000, np.array([0.95, 0.9, 0.8, 0.7, 0.9])
    truth = rng.random(n) < 0.85
    votes = np.where(rng.random((n, 5)) < acc, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random((n, 5)) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.85) < 0.02
    for k, a in enumerate(acc):
        assert abs(model.weights[k][1] - np.log(a / (1 - a))) < 0.4


def test_filter_keeps_rows_whole(spark):
    docs = awkward(spark)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r["id"]) for r in quality.judge(docs).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_empty(spark):
    assert quality.judge(empty(spark)).count() == 0
    assert quality.filter_documents(empty(spark)).count() == 0

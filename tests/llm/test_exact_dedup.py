import hashlib
from collections import defaultdict

import numpy as np

from basketry.llm import exact_dedup
from tests.llm.fixtures import awkward, awkward_texts, empty, texts_only


def brute(rows):
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        known = [x for x in ids[t or ""] if x is not None]
        keep = max(known) if known else None
        out.append((str(i), str(keep), len(ids[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def got(out):
    return sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["kept"], bytes(r["digest"]).hex())
                  for r in out.collect())


def test_awkward_documents_equal_brute_force(spark):
    assert got(exact_dedup.dedup_documents(awkward(spark))) == brute(awkward_texts())


def test_any_split_into_history_and_batch_gives_the_same(spark):
    rows = awkward_texts()
    digests = exact_dedup.digest_rows(awkward(spark))
    for old in ("true", "false", "id % 3 = 0", "id is null"):
        condition = exact_dedup.F.coalesce(exact_dedup.F.expr(old), exact_dedup.F.lit(False))
        assert got(exact_dedup.exact_dedup(digests.where(~condition), digests.where(condition))) == brute(rows), old


def test_one_hot_text(spark):
    rows = [(k, "the same" if k % 3 else f"text {k % 90}", "a") for k in range(2000)]
    assert got(exact_dedup.dedup_documents(texts_only(spark, rows).repartition(5))) == brute(rows)


def test_perfect_hash_is_minimal_and_rejects_by_digest():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(5000)), np.uint64).reshape(-1, 4)
    mph = exact_dedup.PerfectHash.build(keys[:4000])
    assert sorted(mph.slots(keys[:4000]).tolist()) == list(range(4000))
    strangers = mph.slots(keys[4000:])
    assert ((strangers >= -1) & (strangers < 4000)).all()
    slots = np.empty((4000, 4), np.uint64)
    slots[mph.slots(keys[:4000])] = keys[:4000]
    hit = strangers >= 0
    assert not (slots[strangers[hit]] == keys[4000:][hit]).all(axis=1).any()


def test_empty(spark):
    assert exact_dedup.dedup_documents(empty(spark)).count() == 0

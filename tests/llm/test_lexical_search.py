import math
import random
import re
from collections import Counter

import numpy as np

from basketry.llm import lexical_search
from basketry.llm.lexical_search import SearchConfig
from tests.llm.fixtures import awkward, awkward_texts, empty, texts_only

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    read = [(i, terms(t)) for i, t in docs]
    read = [(i, Counter(t), len(t)) for i, t in read if t]
    n, total = len(read), sum(m for _, _, m in read)
    df = Counter(t for _, c, _ in read for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for doc_id, c, m in read:
            norm = 100 - 75 + (75 * m * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * norm)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "item_id long, text string, doc_id long, item string, score long")


ITEMS = [(1, "w1 w2 W3, w4 w5"), (2, None), (3, ""), (4, "nowhere-at-all qqqq"), (5, "same same SAME one two"), (6, "É Éa ÉA nbsp"),
         (7, " ".join(f"w{k}" for k in range(300))), (7, "w7 another text of the id"), (8, "a b c"), (8, "a b c"), (None, "text id w9")]


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_scoring_every_document(spark):
    docs = [(i, t) for i, t, _ in awkward_texts()]
    for config in (SearchConfig(), SearchConfig(shard_postings=50, first_depth=1), SearchConfig(k=3, batch_terms=40)):
        got = found(lexical_search.search(awkward(spark), items_of(spark, ITEMS), config=config))
        assert got == brute(docs, ITEMS, config.k)


def test_ties_go_by_id_null_last_and_repeated_ids_stay(spark):
    rows = [(i, "tie tie word", "s") for i in (9, 3, 3, None, 7, -1)] + [(50 + k, f"other text {k}", "s") for k in range(30)]
    got = found(lexical_search.search(texts_only(spark, rows), items_of(spark, [(1, "tie")])))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [-1, 3, 3, 7, 9, None]
    assert len({r[3] for r in got}) == 1 and got == brute([r[:2] for r in rows], [(1, "tie")])


def test_empty_tables(spark):
    assert found(lexical_search.search(empty(spark), items_of(spark, ITEMS))) == []
    assert found(lexical_search.search(awkward(spark), items_of(spark, []))) == []
    assert found(lexical_search.search(texts_only(spark, [(1, " ", "s"), (2, None, "s")]), items_of(spark, ITEMS))) == []


def test_nra_equals_adding_all_up():
    rng = np.random.default_rng(1)
    for trial in range(200):
        n, m = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        full, lists = np.zeros(n, dtype=np.int64), []
        for _ in range(m):
            docs = rng.permutation(n)[:rng.integers(0, n + 1)]
            impacts = np.sort(rng.integers(1, 6 if trial % 2 else 10**6, len(docs)))[::-1].astype(np.int64)
            full[docs] += impacts
            lists.append((docs, impacts))
        order = rng.permutation(n)
        k = int(rng.integers(1, 12))
        want = sorted(np.flatnonzero(full).tolist(), key=lambda d: (-full[d], order[d]))[:k]
        assert lexical_search.nra(lists, order, k, 1) == [(d, int(full[d])) for d in want]


def test_nra_stops_before_the_end():
    """With one document far ahead in every list, most postings are never read."""
    n = 10_000

    reads = []
    real = np.bincount

    def spy(x, *args, **kw):
        reads.append(len(x))
        return real(x, *args, **kw)

    lists = [(np.concatenate([[5], np.delete(np.arange(n), 5)]), np.concatenate([[10**6], np.full(n - 1, 3)])) for _ in range(4)]
    lexical_search.np.bincount = spy
    try:
        assert lexical_search.nra(lists, np.arange(n), 1, 16) == [(5, 4 * 10**6)]
    finally:
        lexical_search.np.bincount = real
    assert sum(reads) < n


def test_terms_in_bytes_equal_the_pattern():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(0, 0x250), rng.randrange(0x1F600, 0x1F610), 0xA0, 0x85, 0x2028]))
                       for _ in range(rng.randrange(0, 60)))
        assert [t.decode() for t in lexical_search.term_bytes(text.encode())] == terms(text)

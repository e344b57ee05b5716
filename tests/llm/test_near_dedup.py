import random
from collections import defaultdict

from basketry.llm import components, near_dedup
from tests.llm.fixtures import awkward, awkward_texts, empty, prose, texts_only


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[k:k + n]) for k in range(len(words) - n + 1))


def brute(rows, n):
    """(n_shingles, smallest id reachable) per row, all pairs compared."""
    sets = [shingles(t, n) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted((str(rows[k][0]), len(sets[k]), str(least[find(k)])) for k in range(len(rows)))


def got(df, n, **more):
    out = near_dedup.near_groups(df, config=near_dedup.NearConfig(shingle=n, **more)).collect()
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in out)
    return sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in out)


def test_awkward_documents_equal_brute_force(spark):
    assert got(awkward(spark), 2) == brute(awkward_texts(), 2)


def test_chains_and_a_group_of_near_copies_equal_brute_force(spark):
    rng = random.Random(11)
    words = prose(rng, 120).split()
    rows, now = [], words
    for k in range(60):                      # a chain: neighbours are linked, the ends are far apart
        rows.append((k, " ".join(now), "a"))
        now = [*now]
        for at in rng.sample(range(120), 3):
            now[at] = f"c{k}_{at}"
    for k in range(150):                     # copies of one text, each with its own few changes
        copy = [*words]
        for at in rng.sample(range(120), rng.randrange(0, 16)):
            copy[at] = f"g{k}_{at}"
        rows.append((1000 + k, " ".join(copy), "a"))
    rows += [(5000 + k, prose(rng, rng.randrange(0, 12), 6), "b") for k in range(120)]      # tiny sets, many ties
    assert got(texts_only(spark, rows).repartition(4), 2) == brute(rows, 2)


def test_same_text_under_one_id_and_two(spark):
    rows = [(7, "a b c d e f", "x"), (7, "a b c d e f", "x"), (3, "a b c d e f", "x"), (9, "other words here", "x")]
    assert got(texts_only(spark, rows), 2) == brute(rows, 2)


def test_many_texts_under_one_id(spark):
    """Near copies and strangers that share a null or repeated id: each set is read from its own text only."""
    rng = random.Random(3)
    words = prose(rng, 100).split()
    rows = []
    for k in range(200):
        copy = [*words]
        for at in rng.sample(range(100), rng.randrange(0, 8)):
            copy[at] = f"g{k}_{at}"
        rows.append((None if k % 2 else 77, " ".join(copy), "a"))
    rows += [(None, prose(rng, 30), "a") for _ in range(100)] + [(5, prose(rng, 30), "a") for _ in range(50)]
    assert got(texts_only(spark, rows).repartition(3), 2) == brute(rows, 2)


def test_full_sets_are_joined_by_id_and_text(spark, monkeypatch):
    """2,000 texts under one id give 2,000 sets to compute, not their square."""
    rng = random.Random(4)
    words = prose(rng, 60).split()
    rows = []
    for k in range(2000):
        copy = [*words]
        copy[rng.randrange(60)] = f"g{k}"
        rows.append((None, " ".join(copy), "a"))
    computed = spark.sparkContext.accumulator(0)
    whole = near_dedup.full_sets

    def counted(text_col, c):
        one = near_dedup.F.udf(lambda t: computed.add(1) or t, "string").asNondeterministic()
        return whole(one(text_col), c)

    monkeypatch.setattr(near_dedup, "full_sets", counted)
    out = near_dedup.near_groups(texts_only(spark, rows).repartition(4), config=near_dedup.NearConfig(shingle=2))
    assert out.select("root").distinct().count() == 1
    assert 0 < computed.value <= 4000


def templated(rng, n, own):
    """Texts of one template of 160 words and ``own`` words of their own at the end: unlinked for 40 or more."""
    body = " ".join(f"t{k}" for k in range(160))
    return [(k, body + " " + " ".join(f"o{k}_{j}" for j in range(own)), "a") for k in range(n)]


def test_prefixes_of_hot_buckets_equal_brute_force(spark):
    """Buckets of texts around templates, some of them linked, with every bucket taken as hot."""
    rng = random.Random(5)
    rows = templated(rng, 60, 40)
    rows += [(1000 + k, rows[k % 60][1] + f" tail{k}" * rng.randrange(1, 4), "a") for k in range(40)]
    words = prose(rng, 60, 200).split()
    for k in range(120):
        copy = [*words]
        for at in rng.sample(range(60), rng.randrange(3, 20)):
            copy[at] = f"g{rng.randrange(60)}"
        rows.append((2000 + k, " ".join(copy[:rng.randrange(45, 61)]), "b"))
    for hot in (0, 3):
        assert got(texts_only(spark, rows).repartition(3), 2, hot_bucket=hot) == brute(rows, 2)


def test_unlinked_texts_of_a_template_make_few_pairs(spark, monkeypatch):
    """1,000 texts that share 0.67 of their shingles: some checks a text, not the square."""
    counts = []
    whole = near_dedup.confirm

    def counted(pairs, sets):
        counts.append(pairs.count())
        return whole(pairs, sets)

    monkeypatch.setattr(near_dedup, "confirm", counted)
    rows = templated(random.Random(6), 1000, 40)
    out = near_dedup.near_groups(texts_only(spark, rows).repartition(4), config=near_dedup.NearConfig(shingle=2))
    assert out.where("not kept").isEmpty()
    assert counts[-1] <= 64 * 1000 and sum(counts) <= 100_000


def test_minmax_shares_buckets_as_computed():
    """Share of equal buckets of pairs at similarity 0.8 is near similarity to the power of rows."""
    import numpy as np
    c = near_dedup.NearConfig()
    m, rng = near_dedup.MinMax(c), np.random.default_rng(1)
    share = []
    for _ in range(60):
        x = np.unique(rng.integers(0, 2**63, 450, dtype=np.uint64))
        a, b = x[:len(x) * 9 // 10], x[len(x) // 10:]
        share.append((m.keys(a) == m.keys(b)).mean())
    assert abs(np.mean(share) - 0.8 ** c.rows) < 0.06


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1005, 1001), (2000, 2000)]
    df = spark.createDataFrame(random.Random(1).sample(edges, len(edges)), "a long, b long")
    roots = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert roots == {k: 0 for k in range(1, 301)} | {1001: 1000, 1005: 1000}


def test_forests_and_merged_components(spark):
    parents = spark.createDataFrame([(k, k // 2) for k in range(1, 200)] + [(1001, 1000)], "node long, parent long") \
        .where("node <> 1")
    roots = components.follow_parents(parents)
    assert {r["node"]: r["root"] for r in roots.collect()} == {k: 1 for k in range(2, 200)} | {1001: 1000}
    more = spark.createDataFrame([(150, 1001), (3000, 3001), (5, 6)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.merge_components(roots, more).collect()}
    assert got == {k: 1 for k in range(2, 200)} | {1000: 1, 1001: 1, 3001: 3000}
    assert components.merge_components(roots, more.where("a = 5")).exceptAll(roots).isEmpty()


def test_empty(spark):
    assert near_dedup.near_groups(empty(spark)).count() == 0

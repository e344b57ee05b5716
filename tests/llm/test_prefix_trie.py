import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from basketry.llm import prefix_trie
from basketry.llm.prefix_trie import TrieConfig

SCHEMA = ("conv_id long, turn long, role string, text string, position long, shard long, band long, a long, b long, "
          "depth long, words long, members string, digest string, length long, part long, h long, k long, own long")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, "m", "d", 8, 9, 1, 2, 3) for r in rows], SCHEMA).repartition(partitions)


def ordered(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by[c].append(((turn is not None, turn or 0), digest, (role, text)))
    return {c: [t for *_, t in sorted(v)] for c, v in by.items()}


def rebuilt(convs, every=20, heads=4):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        rest = abs(c) % every * (1 if c >= 0 else -1)
        out[c] = convs.get(c - rest, [])[:h] + turns[h:]
    return out


def brute(convs):
    """The nodes' rows, from a dictionary of every prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        turns = tuple(convs[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, held in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(held) - 1) * words
    return sorted(((held[0], len(p), members[p[:-1]][0] if p else None, len(held), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, held in members.items()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def chats(seed=1, n=300):
    rng = random.Random(seed)
    system = ("system", "be kind and short")
    rows = []
    for c in [*range(n), 2**61 + 5, 2**61 + 6, -7, -25, -40]:
        turns = [system] if rng.random() < 0.4 else []
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["hello there", "a b c", "", None, "one", "x" * 3000]))
                  for _ in range(rng.randrange(0, 7))]
        if c % 10 == 3:
            turns = [system, ("user", "the same question"), ("assistant", "the same answer")]
        rows += [(c, k if k or rng.random() < 0.7 else None, *t) for k, t in enumerate(turns)]
    rows += [(12, 0, "user", "tie one"), (12, 0, "user", "tie two"), (12, 0, "user", "tie two"), (None, 0, "user", "no id")]
    return rows


@pytest.mark.parametrize("config", [TrieConfig(), TrieConfig(shard_convs=7, band=2)])
def test_rebuilt_conversations_equal_brute_force(spark, config):
    rows = chats()
    turns, convs = prefix_trie.share_heads(prefix_trie.number_turns(table(spark, rows)))
    assert rows_of(prefix_trie.build_trie(turns, convs, config)) == brute(rebuilt(ordered(rows)))


def test_plain_conversations_equal_brute_force(spark):
    rows = chats(2, 120)
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows), config=TrieConfig(40, 3))) == brute(ordered(rows))


def test_long_conversations_share_and_part_within_bands(spark):
    long = [("user", f"turn {k}") for k in range(1100)]
    convs = {1: long, 2: long, 3: long[:700] + [("user", "else")], 4: long[:256], 5: long[:512] + long[:100], 6: [long[0]]}
    rows = [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]
    for config in (TrieConfig(), TrieConfig(shard_convs=2, band=100)):
        assert rows_of(prefix_trie.prefix_trie(table(spark, rows), config=config)) == brute(convs)


def test_turnless_conversations_end_in_the_root(spark):
    ids = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0]
    rows = [(c, 0, "user", "only turn") for c in ids]                 # no conversation 20: the first turn is lost
    turns, convs = prefix_trie.share_heads(prefix_trie.number_turns(table(spark, rows)))
    got = rows_of(prefix_trie.build_trie(turns, convs, TrieConfig(shard_convs=3)))
    sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == [(ids[0], 0, None, len(ids), 0, 1, 0, sha)]


def test_empty_table(spark):
    assert rows_of(prefix_trie.prefix_trie(table(spark, []))) == []
    turns, convs = prefix_trie.share_heads(prefix_trie.number_turns(table(spark, [(None, 1, "user", "x")])))
    assert rows_of(prefix_trie.build_trie(turns, convs)) == []


def test_copies_of_one_conversation(spark):
    rows = [(c, k, "user", f"same {k}") for c in range(500) for k in range(4)] + [(900, 0, "user", "same 0")]
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows), config=TrieConfig(shard_convs=64))) == brute(ordered(rows))

"""Quality by weak supervision: rules vote or abstain, and EM finds what their votes are worth.

Each rule looks at one feature of a text and votes good (+1), bad (-1) or
abstains (0). No labels are used: expectation-maximisation over the votes
estimates, for a two-class naive Bayes model, each rule's probability of every
vote in good and in bad texts and the share of good texts. A document's
posterior probability of being good then replaces a filter that every rule
must pass.

The votes of R rules have at most 3^R patterns, however many documents there
are. Documents are counted by pattern (partial sums before any shuffle), and
only those counts come to the driver, where EM runs on them; the posterior is
a sum of one constant a rule, applied where the document is read.

EM starts from rules that are right more often than not and stays on that
side: in every step a good vote is kept at least as likely in good texts as in
bad ones and a bad vote the other way round, so the classes cannot swap. The
starting belief counts like a few documents of each class, so that small tables
and rules that never vote are harmless.

Defined cases: a null or empty text has no words and every feature 0, and is
rejected by the base rule; rows that repeat are judged alike and each counts;
an empty table gives an empty result; other columns are kept by
``filter_documents`` and ignored by ``judge`` whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WordHashes, cut, mix64

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_letters", "n_upper", "n_marked_words", "n_distinct_words", "n_sentence_ends")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Votes -1 where ``bad`` holds, +1 where ``good`` holds, else abstains."""
    name: str
    good: str
    bad: str


# Shares are written without division so that empty texts need no special case.
RULES = (
    Rule("length", "n_words >= 80", "n_words < 20"),
    Rule("word_length", "word_chars between 3 * n_words and 10 * n_words",
         "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("symbols", "100 * n_symbols <= 2 * n_words", "100 * n_symbols > 20 * n_words"),
    Rule("marked_words", "100 * n_marked_words <= 5 * n_words", "100 * n_marked_words > 40 * n_words"),
    Rule("repeats", "100 * n_repeat_words <= 10 * n_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("distinct_words", "100 * n_distinct_words >= 20 * n_words or n_words > 2000",
         "100 * n_distinct_words < 5 * n_words"),
    Rule("case", "100 * n_upper <= 15 * n_letters", "100 * n_upper > 50 * n_letters"),
    Rule("letters", "100 * n_letters >= 70 * word_chars", "100 * n_letters < 50 * word_chars"),
    Rule("sentences", "100 * n_sentence_ends >= n_words", "300 * n_sentence_ends < n_words and n_words >= 50"),
)
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def repeated_words(hashes: np.ndarray) -> int:
    """Words in a window of three consecutive words that is found twice or more."""
    if len(hashes) < 4:
        return 0
    h = mix64(hashes)
    windows = mix64(mix64(h[:-2] + np.uint64(1)) + h[1:-1] + np.uint64(2)) + h[2:]
    _, where, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[k:k + len(again)] |= again
    return int(covered.sum())


def features(text: str | None, known: WordHashes) -> tuple[int, ...]:
    """The values of FEATURES for one text."""
    if not text:
        return (0,) * len(FEATURES)
    raw = text.encode()
    words = raw.split()                 # on ASCII space, tab, LF, VT, FF and CR only
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS))) + (0,) * (len(FEATURES) - 3)
    space = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = Counter(line for line in raw.split(b"\n") if line.split())
    dup = sum(lines.values()) - len(lines)
    if text.isascii():
        letters, upper = (len(raw) - len(raw.translate(None, x)) for x in (_LETTERS, _UPPER))
    else:
        letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    marked = sum(1 for w in words if w[-1:] in _MARKS or w[:1] in _MARKS)
    ends = sum(1 for w in words if w[-1:] in _ENDS)
    return (n, len(text) - space, sum(map(text.count, SYMBOLS)), dup, repeated_words(known.of(words)),
            letters, upper, marked, len(set(words)), ends)


_MARKS = frozenset(b"%c" % c for c in SYMBOLS.encode())
_ENDS = frozenset((b".", b"!", b"?"))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def feature_column(text_col: str) -> Column:
    """Struct of FEATURES, computed on Arrow batches of texts."""
    kind = "struct<" + ",".join(f"{f}:long" for f in FEATURES) + ">"

    @F.arrow_udf(kind)
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WordHashes()
        for texts in batches:
            rows = [features(t, known) for t in texts.to_pylist()]
            cols = list(zip(*rows)) if rows else [[] for _ in FEATURES]
            yield pa.StructArray.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=list(FEATURES))

    return compute(F.col(text_col))


def votes(rules: Iterable[Rule] = RULES) -> list[Column]:
    return [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(r.name) for r in rules]


@dataclass(frozen=True)
class Model:
    """Share of good texts, and log P(vote | good) - log P(vote | bad) of every rule and vote."""
    prior: float
    weights: tuple[dict[int, float], ...]


# Belief before any data, as P(bad vote, abstention, good vote): a good text gets good votes from
# nearly all rules; a bad one is caught by a few of them and looks normal to the others.
IN_GOOD = (0.005, 0.025, 0.97)
IN_BAD = (0.2, 0.05, 0.75)


def fit(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.8, rounds: int = 500,
        belief: float = 30.0) -> Model:
    """EM on vote patterns (rows of -1, 0, 1) and how many documents have each.

    The belief before any data counts like ``belief`` documents of each class,
    which matters only in small tables.
    """
    r = patterns.shape[1]
    good, bad = (np.tile(np.array(x), (r, 1)) for x in (IN_GOOD, IN_BAD))      # of each rule
    believed = good.copy(), bad.copy()
    start, which = prior, patterns.T + 1
    total = max(counts.sum(), 1)
    for _ in range(rounds if len(counts) else 0):
        odds = math.log(prior / (1 - prior)) + sum(np.log(good[k] / bad[k])[which[k]] for k in range(r))
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        before = prior
        prior = float(np.clip(((counts * p).sum() + belief * start) / (total + belief), 0.05, 0.99))
        for k in range(r):
            for table, w, at_first in ((good, counts * p, believed[0]), (bad, counts * (1 - p), believed[1])):
                seen = np.bincount(which[k], weights=w, minlength=3) + belief * at_first[k]
                table[k] = seen / seen.sum()
            # a good vote never speaks for bad, nor a bad vote for good
            for v, (more, less) in ((2, (good, bad)), (0, (bad, good))):
                if more[k, v] < less[k, v]:
                    more[k, v] = less[k, v] = (more[k, v] + less[k, v]) / 2
            good[k] /= good[k].sum()
            bad[k] /= bad[k].sum()
        if abs(prior - before) < 1e-9:
            break
    return Model(prior, tuple({v: float(math.log(good[k, v + 1] / bad[k, v + 1])) for v in (-1, 0, 1)}
                              for k in range(r)))


def learn(judged: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """Fit the model on all rows that the base rule keeps (columns of FEATURES)."""
    names = [r.name for r in rules]
    rows = (judged.where(~F.expr(BASE_FAILED)).select(*votes(rules)).groupBy(*names)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect())      # at most 3 ** len(rules) rows
    patterns = np.array([[row[n] for n in names] for row in rows], dtype=np.int64).reshape(len(rows), len(names))
    return fit(patterns, np.array([row["n"] for row in rows], dtype=float))


def posterior(model: Model, rules: tuple[Rule, ...] = RULES) -> Column:
    """Probability that a text is good, from the columns of FEATURES."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for vote, w in zip(votes(rules), model.weights):
        odds = odds + F.when(vote == 1, w[1]).when(vote == -1, w[-1]).otherwise(w[0])
    return 1 / (1 + F.exp(-odds))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
          rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``df``: id, FEATURES, base_failed, quality (posterior), kept."""
    rows = cut(df.select(F.col(id_col).alias("id"), feature_column(text_col).alias("f")).select("id", "f.*"))
    model = learn(rows, rules)
    return (rows.withColumn("base_failed", F.expr(BASE_FAILED))
            .withColumn("quality", posterior(model, rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def filter_documents(df: DataFrame, text_col: str = "text", threshold: float = 0.5,
                     rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that are kept, with their columns.

    Features are computed once to learn and once more to decide, so that no
    text is shuffled or written.
    """
    model = learn(cut(df.select(feature_column(text_col).alias("f")).select("f.*")), rules)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    judged = df.select(row, feature_column(text_col).alias("f")).select("row", "f.*")
    return judged.where(~F.expr(BASE_FAILED) & (posterior(model, rules) >= threshold)).select("row.*")

"""Language identification with bit-sliced Bloom filters over character n-grams.

One filter holds the n-grams of every language: each cell is a bitmask with
one bit a language, so looking a single n-gram up (and-ing its few cells)
returns all languages that contain it. A text's n-grams are looked up, the
bits of each language are counted, the count is corrected for the filter's
known rate of false positives, and the largest corrected share decides.

Training takes the labelled rows it is given. Their n-grams are counted a
language (partial counts in each task before the shuffle) on a bounded sample:
about ``sample_per_language`` documents of each language, chosen by a hash of
the id, of the text where there is no id (a documented bound; prediction covers every row and whole texts). An
n-gram enters a language's filter if it makes up at least ``min_share`` of
that language's n-grams, so a language has at most ``1 / min_share`` of them.
The number of cells follows the largest language's n-grams, ``cells_per_ngram``
each, so no n-gram is left out and what is sent to the tasks stays bounded (64 MB for
64 languages). The masks are put together in tasks, a range of cells each.

Defined cases: a null text, or one without a letter, gets ``und`` and score 0;
rows that repeat are treated alike; ties go to the language with more training
documents, then to the smaller code point; a text whose n-grams are all
unknown gets the most frequent language with score 0; without training rows
everything is ``und``; an empty table gives an empty result; other columns are
ignored in training and kept in prediction, but one named ``prediction`` is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import cut, mix64

UNKNOWN = "und"


@dataclass(frozen=True)
class LangConfig:
    """n-gram length, filter size and training bounds."""
    n: int = 4
    cells: int = 1 << 20            # at least
    cells_per_ngram: int = 8
    hashes: int = 3
    sample_per_language: int = 2000
    min_share: float = 1e-6

    def sized(self, ngrams: int) -> LangConfig:
        """With cells enough (a power of two) for a language of that many n-grams."""
        return replace(self, cells=max(self.cells, 1 << (self.cells_per_ngram * ngrams - 1).bit_length()) if ngrams
                       else self.cells)


def letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters as one 0, 0 at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = _letter_table()[points]
    out = np.where(is_letter, points, 0)
    out = np.concatenate(([0], out, [0])).astype(np.uint64)
    return out[np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))]


_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every n-gram."""
    if len(points) < n:
        points = np.concatenate((points, np.zeros(n - len(points), dtype=np.uint64)))
    m = len(points) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h = mix64(h) + points[k:k + m]
    return mix64(h)


def cells_of(hashes: np.ndarray, c: LangConfig) -> list[np.ndarray]:
    """The cells of each hash, by double hashing."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) % np.uint64(c.cells)).astype(np.int64) for k in range(c.hashes)]


class LanguageFilters:
    """Bit-sliced filters: ``masks[word, cell]`` holds 64 languages' bits."""

    def __init__(self, languages: list[str], entries: dict[str, np.ndarray], c: LangConfig,
                 masks: np.ndarray | None = None):
        self.languages, self.c = languages, c
        self.masks = np.zeros((-(-len(languages) // 64) or 1, c.cells), dtype=np.uint64) if masks is None else masks
        for k, lang in enumerate(languages):
            for cell in cells_of(entries.get(lang, np.zeros(0, np.uint64)), c):
                self.masks[k // 64][cell] |= np.uint64(1 << (k % 64))
        # the chance that an n-gram a language lacks is reported as present
        filled = np.array([np.count_nonzero(self.masks[k // 64] & np.uint64(1 << (k % 64)))
                           for k in range(len(languages))]) / c.cells
        self.false_rate = filled ** c.hashes

    def predict(self, text: str | None) -> tuple[str, float]:
        points = letters_only(text) if text else np.zeros(0, np.uint64)
        if not points.any() or not self.languages:
            return UNKNOWN, 0.0
        cells = cells_of(ngram_hashes(points, self.c.n), self.c)
        share = np.zeros(len(self.languages))
        for word, masks in enumerate(self.masks):
            found = masks[cells[0]]
            for cell in cells[1:]:
                found = found & masks[cell]
            patterns, count = np.unique(found, return_counts=True)
            for k in range(word * 64, min(len(self.languages), word * 64 + 64)):
                share[k] = count[(patterns >> np.uint64(k % 64)) & np.uint64(1) == 1].sum()
        share /= len(cells[0])
        share = np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


MASK_BLOCK = 4096           # cells a block of masks


def known_ngrams(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 config: LangConfig = LangConfig()) -> tuple[list[str], DataFrame]:
    """The languages of ``labelled``, and rows (k, ngram): the n-grams of language number k."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}             # one row a language
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return [], labelled.sparkSession.createDataFrame([], "k int, ngram long")
    share = F.create_map(*[F.lit(x) for lang in languages
                           for x in (lang, min(1.0, config.sample_per_language / sizes[lang]))])
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    chance = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), 1, 12), 16, 10) \
        .cast("double") / 2.0 ** 48
    sample = rows.where(chance < share[F.col(lang_col)]).select(number[F.col(lang_col)].alias("k"),
                                                                F.col(text_col).alias("text"))
    n, schema = config.n, "k int, ngram long, n long"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[int, list[np.ndarray]] = {}
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points = letters_only(text)
                if points.any():
                    by_lang.setdefault(k, []).append(ngram_hashes(points, n))
            for k, parts in by_lang.items():
                grams, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(grams), k, dtype=np.int32)),
                                                  "ngram": grams.view(np.int64), "n": c.astype(np.int64)})

    counts = cut(sample.mapInArrow(count, schema).groupBy("k", "ngram").agg(F.sum("n").alias("n")))
    least = counts.groupBy("k").agg(F.greatest(F.lit(2.0), config.min_share * F.sum("n")).alias("least"))
    return languages, counts.join(F.broadcast(least), "k").where("n >= least").select("k", "ngram")   # a row a language


def filter_masks(known: DataFrame, languages: int, c: LangConfig) -> np.ndarray:
    """``masks[word, cell]`` of rows (k, ngram): bits are or-ed in tasks, blocks of cells come to the driver."""
    def to_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            grams = np.ascontiguousarray(batch.column(1).to_numpy()).view(np.uint64)
            bits = np.left_shift(np.uint64(1), (k % 64).astype(np.uint64)).view(np.int64)
            for cell in cells_of(grams, c):
                yield pa.RecordBatch.from_pydict({"word": pa.array((k // 64).astype(np.int32)), "cell": cell, "bits": bits})

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(MASK_BLOCK, dtype=np.int64)
        out[rows["cell"].to_numpy() % MASK_BLOCK] = rows["bits"].to_numpy()
        return pd.DataFrame({"word": rows["word"].iloc[:1], "block": rows["block"].iloc[:1], "masks": [out.tobytes()]})

    cells = (known.mapInArrow(to_cells, "word int, cell long, bits long").groupBy("word", "cell")
             .agg(F.bit_or("bits").alias("bits")).withColumn("block", F.floor(F.col("cell") / MASK_BLOCK)))
    blocks = cells.groupBy("word", "block").applyInPandas(block, "word int, block long, masks binary")
    masks = np.zeros((-(-languages // 64) or 1, c.cells), dtype=np.uint64)
    for r in blocks.toLocalIterator():                                  # at most c.cells * 8 bytes for 64 languages
        at = r["block"] * MASK_BLOCK
        masks[r["word"], at:at + MASK_BLOCK] = np.frombuffer(r["masks"], dtype=np.uint64)[:c.cells - at]
    return masks


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          config: LangConfig = LangConfig()) -> LanguageFilters:
    """Filters of the languages in ``labelled`` (rows with a null label or text are left out)."""
    languages, known = known_ngrams(labelled, id_col, text_col, lang_col, config)
    if not languages:
        return LanguageFilters([], {}, config)
    most = known.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    sized = config.sized(most)
    return LanguageFilters(languages, {}, sized, filter_masks(known, len(languages), sized))


def predict(df: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """``df`` with ``prediction``, a struct of lang and score."""
    shared = df.sparkSession.sparkContext.broadcast(filters)           # cells * 8 bytes for up to 64 languages

    @F.arrow_udf("struct<lang:string,score:double>")
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = shared.value
        for texts in batches:
            out = [f.predict(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], type=pa.string()),
                                              pa.array([x[1] for x in out], type=pa.float64())],
                                             names=["lang", "score"])

    return df.withColumn("prediction", decide(F.col(text_col)))

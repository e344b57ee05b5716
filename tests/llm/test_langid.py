import numpy as np

from basketry.llm import langid
from tests.llm.fixtures import awkward, empty


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = langid.F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2
    filters = langid.train(docs.where(~held))
    rows = langid.predict(docs.where(held & langid.F.col("lang").isNotNull()), filters).collect()
    assert rows
    right = sum(r["prediction"]["lang"] == r["lang"] for r in rows)
    assert right >= 0.95 * len(rows)
    assert all(0 <= r["prediction"]["score"] <= 1 for r in rows)


def test_awkward_texts(spark):
    filters = langid.LanguageFilters(["en", "de"], {
        "en": langid.ngram_hashes(langid.letters_only("one two the other text with words"), 4),
        "de": langid.ngram_hashes(langid.letters_only("eins zwei der andere satz mit wort"), 4)}, langid.LangConfig())
    rows = {r["doc_id"]: r["prediction"] for r in langid.predict(awkward(spark), filters).collect()}
    assert [tuple(rows[k]) for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert tuple(rows[21])[0] in ("en", "de")
    assert rows[5]["lang"] == "en" and rows[5]["score"] == 1.0
    assert rows[16]["lang"] == "en" and rows[16]["score"] < 0.01       # nothing known: the first language


def test_no_language_is_missed_and_false_positives_are_corrected():
    rng = np.random.default_rng(9)
    c = langid.LangConfig(cells=1 << 14, hashes=2)
    grams = {f"l{k:03d}": rng.integers(0, 2**63, 2000, dtype=np.uint64) for k in range(70)}      # two mask words
    f = langid.LanguageFilters(list(grams), grams, c)
    for k, lang in enumerate(grams):
        found = f.masks[k // 64][langid.cells_of(grams[lang], c)[0]] & f.masks[k // 64][langid.cells_of(grams[lang], c)[1]]
        assert ((found >> np.uint64(k % 64)) & np.uint64(1)).all()
    strangers = langid.cells_of(rng.integers(0, 2**63, 200_000, dtype=np.uint64), c)
    hit = ((f.masks[0][strangers[0]] & f.masks[0][strangers[1]]) & np.uint64(1)).mean()
    assert abs(hit - f.false_rate[0]) < 0.01


def test_no_training_rows_and_empty(spark):
    filters = langid.train(empty(spark))
    assert filters.languages == []
    assert {r["prediction"]["lang"] for r in langid.predict(awkward(spark), filters).collect()} == {"und"}
    assert langid.predict(empty(spark), filters).count() == 0


def test_masks_built_in_tasks_equal_those_of_one_process(spark):
    rng = np.random.default_rng(4)
    c = langid.LangConfig(cells=1 << 13)
    grams = [rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(130)]                   # three mask words
    rows = spark.createDataFrame([(k, int(g.view(np.int64))) for k, gs in enumerate(grams) for g in gs], "k int, ngram long")
    names = [f"l{k}" for k in range(130)]
    want = langid.LanguageFilters(names, dict(zip(names, grams)), c).masks
    assert (langid.filter_masks(rows.repartition(7), 130, c) == want).all()
    assert not langid.filter_masks(rows.where("false"), 1, c).any()


def test_cells_follow_the_ngrams():
    c = langid.LangConfig()
    assert c.sized(0) == c and c.sized(100).cells == 1 << 20
    assert c.sized(1_000_000).cells == 1 << 23


def test_predictions_against_sets(spark, sf_dir):
    """The same decision with plain sets of n-grams in place of the filters, within their false positives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    config = langid.LangConfig(cells=1 << 12, cells_per_ngram=4)          # small, so that false positives count
    languages, known = langid.known_ngrams(docs, config=config)
    sets = [set() for _ in languages]
    for r in known.collect():
        sets[r["k"]].add(r["ngram"])
    filters = langid.train(docs, config=config)
    assert filters.c.cells >= 4 * max(map(len, sets)) and filters.languages == languages
    for r in langid.predict(docs.select("text"), filters).collect():
        points = langid.letters_only(r["text"] or "")
        if not points.any():
            assert tuple(r["prediction"]) == ("und", 0.0)
            continue
        grams = langid.ngram_hashes(points, config.n).view(np.int64).tolist()
        share = [sum(g in s for g in grams) / len(grams) for s in sets]
        best = max(range(len(sets)), key=lambda k: (share[k], -k))
        close = 5 / len(grams) ** 0.5                                     # of the corrected share
        assert abs(r["prediction"]["score"] - max(share)) <= close
        assert share[languages.index(r["prediction"]["lang"])] >= share[best] - 2 * close


def test_rows_without_ids_are_sampled_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"some words of text number {k} in a row", "en") for k in range(400)],
                                 "doc_id long, text string, lang string")
    one = langid.LangConfig(sample_per_language=200)
    languages, known = langid.known_ngrams(docs, config=one)
    assert languages == ["en"] and not known.isEmpty()

from collections import Counter

import corpus_pipeline
from basketry.llm import exact_dedup, mixing, quality
from tests.llm import test_exact_dedup, test_near_dedup
from tests.llm.fixtures import awkward, awkward_texts, texts_only


def test_stages_agree_with_brute_force(spark):
    """Each stage's survivors, followed through plain Python versions of the decisions."""
    docs = awkward(spark)
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "packing"]

    out = stage["exact_dedup"](spark, docs, "")
    assert out.columns == columns
    kept = {(i, h) for i, _, _, k, h in test_exact_dedup.brute(awkward_texts()) if k}
    got = sorted((str(r["id"]), bytes(r["digest"]).hex()) for r in exact_dedup.digest_rows(out).collect())
    assert set(got) == kept

    rows = [(r["doc_id"], r["text"], r["source"]) for r in out.collect()]
    out = stage["near_dedup"](spark, out, "")
    assert out.columns == columns
    want = Counter(i for i, _, c in test_near_dedup.brute(rows, 5) if i == c)
    assert Counter(str(r["doc_id"]) for r in out.collect()) == want

    mixed = stage["source_mix"](spark, out, "")
    assert mixed.columns == columns
    words = mixed.select(mixing.n_words("text").alias("n")).agg({"n": "sum"}).first()[0]
    total = out.select(mixing.n_words("text").alias("n")).agg({"n": "sum"}).first()[0]
    assert abs(words - 1.5 * total) <= 30_000

    pieces = stage["packing"](spark, mixed, "")
    assert pieces.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_run_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = quality.filter_documents(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    fit = quality.judge(judged).where("not base_failed").count()
    kept = good.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").count()
    assert kept >= 0.99 * fit
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() > 0 and pieces.where("length < 1 or offset + length > 2048").count() == 0


def test_one_row_of_equal_or_near_texts_stays(spark):
    """Rows that repeat (id, text), groups without ids, and near copies under one id."""
    stage = dict(corpus_pipeline.STAGES)
    long = [" ".join(f"{p}{k}" for k in range(200)) for p in "abc"]
    rows = [(1, "twice", "x"), (1, "twice", "y"), (1, "twice", "y"), (2, "once", "x"), (None, "no id", "x"), (None, "no id", "x"),
            (None, None, "x"), (None, "", "x"), (3, long[0], "x"), (3, long[0] + " more", "x"), (4, long[0] + " and more", "x"),
            (None, long[1], "x"), (None, long[1] + " more", "x"), (None, long[2], "x"), (None, long[2] + " more", "x"),
            (5, long[2] + " and more", "x"), (None, "alone", "x"), (1, "another text", "x")]
    docs = texts_only(spark, rows).repartition(4)
    out = stage["exact_dedup"](spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"] or "") for r in out.collect())
    assert got == Counter({(i, t or "") for i, t, _ in rows})
    assert [r["source"] for r in out.where("text = 'twice'").collect()] == ["x"]

    for given in (out, docs):
        near = stage["near_dedup"](spark, given, "")
        assert near.columns == docs.columns
        left = Counter(" ".join((r["text"] or "").split()[:1]) for r in near.collect())
        empty = 1 if given is out else 2             # empty sets are linked with nothing
        assert left == {"twice": 1, "once": 1, "no": 1, "": empty, "a0": 1, "b0": 1, "c0": 1, "alone": 1, "another": 1}
        assert [r["doc_id"] for r in near.where("text like 'c0%'").collect()] == [5]


def test_every_stage_bounds_its_batches(spark):
    """A stage that ran without ``run`` sent Python up to 10,000 texts, or 64 MB, at a time."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "64m"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for name, stage in corpus_pipeline.STAGES:
            for k, v in keys.items():
                spark.conf.set(k, v)
            stage(spark, awkward(spark), "")
            assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256, name
            assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{4 << 20}b", name
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

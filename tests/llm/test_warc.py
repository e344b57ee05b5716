import contextlib
import hashlib
import io
import random
import re

from pyspark.sql import functions as F

from basketry.llm import warc
from basketry.session import scratch_path

SCHEMA = ("page_id long, url string, html string, captured_at string, payload string, first_id long, copies long, "
          "payload_digest string, refers_to long")


def pages():
    rng = random.Random(3)
    same, big = "<p>" + "same " * 40, "é" * 60
    rows = [(1, "http://a.example/x", None), (2, None, ""), (3, "http://b.example:80/y?q=1#f", "short"), (4, "bad url \r\n [", "short"),
            (5, "https://www.a.example/x", same), (6, "http://a.example/x", same), (6, "http://a.example/x", same),
            (None, "http://n.example/", same), (None, None, big), (None, None, big), (7, "http://u.example/é", "x\r\n\r\nWARC/1.1\r\n\r\n"),
            (8, "http://u.example/é", "\x00\x01" + "binary-ish " * 30), (9, "http://long.example/", "y" * 300_000)]
    rows += [(100 + k, f"http://h{rng.randrange(5)}.example/p{rng.randrange(20)}", rng.choice([same, big, f"page {k} " * 20]))
             for k in range(300)]
    return [(i, u, h, f"2024-01-{1 + (k * 7) % 28:02d}T00:00:00Z", "p", 0, 1, "d", 2) for k, (i, u, h) in enumerate(rows)]


def brute(rows):
    first = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and f != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force_and_order_is_global(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(4)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(df, path, records_per_archive=25)
    captures = warc.read_captures(spark, path)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in captures.collect()]
    assert sorted(got, key=str) == brute(pages())
    merged = sorted(warc.merge_index(captures, 5).collect(), key=lambda r: r["order"])
    keys = [(r["url_key"], r["captured_at"], -1 if r["page_id"] is None else r["page_id"]) for r in merged]
    assert len(merged) == len(pages()) and keys == sorted(keys)
    assert len({r["archive"] for r in merged}) > 5 and len({r["order"] for r in merged}) == len(merged)


def test_records_are_where_the_index_says(spark):
    df = spark.createDataFrame(pages()[:30], SCHEMA)
    merged = warc.archive_pages(spark, df, scratch_path(spark, "warc-test")).collect()
    content = {r["path"]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(
        merged[0]["archive"].rpartition("/")[0]).collect()}
    for r in merged:
        (at, length, fields, _), = warc.walk(content[r["archive"]][r["at"]:r["at"] + r["length"]])
        assert at == 0 and length == r["length"]
        assert fields["warc-payload-digest"] == "sha256:" + r["payload_digest"]


def test_loser_tree_merges_like_sorted():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(rng.choices(range(15), k=rng.randrange(12))) for _ in range(rng.randrange(9))]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(sum(runs, []))


def test_url_keys():
    assert warc.url_key("HTTP://www.Example.com:8080/A?b=c#d") == "com,example)/A?b=c"
    assert warc.url_key("") == ")/"


def test_empty(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], SCHEMA), scratch_path(spark, "warc-test")).count() == 0


def test_archives_are_bounded_in_bytes(spark, tmp_path):
    """Pages of all sizes with a bound of 64 KB: only a record that is larger on its own exceeds it."""
    rng = random.Random(8)
    rows = [(k, f"http://h{k % 7}.org/{k}", "x" * rng.choice([0, 10, 300, 3000, 20_000, 60_000, 200_000]) + str(k), "2020-01-01T00:00:00Z")
            for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, captured_at string").repartition(3)
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, records_per_archive=50, archive_bytes=64 << 10)
    files = [f.read_bytes() for f in (tmp_path / "archives").glob("part-*")]
    assert all(len(f) <= 64 << 10 or sum(1 for _ in warc.walk(f)) == 1 for f in files)
    assert max(sum(1 for _ in warc.walk(f)) for f in files if f) > 10
    captures = warc.read_captures(spark, path).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in captures) == [(k, len(h)) for k, _, h, _ in rows]


def sides(df):
    """Columns that each exchange of the plan carries, and whether a row's payload is among them."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return [x for x in re.findall(r"\(\d+\) Exchange\n(?:Input \[\d+\]: )(.*)", buf.getvalue())]


def test_payloads_are_not_shuffled(spark):
    """The join by digest was a shuffle of all payloads, whose files and the archives together passed the disk limit."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        decided = warc.decide(spark.createDataFrame(pages(), SCHEMA).repartition(4).localCheckpoint(), 100)
        assert not any(re.search(r"\bpayload#", x) for x in sides(decided))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_rows_that_may_share_a_payload_are_shuffled(spark):
    """Beyond the limit of groups a bitmap finds the rows in groups; the result is the same."""
    df = spark.createDataFrame(pages(), SCHEMA).repartition(4)
    few, many = ([tuple(r) for r in warc.decide(df, 100, limit).select(
        "page_id", "payload_bytes", "payload_digest", "refers_to").collect()] for limit in (200_000, 0))
    assert sorted(few, key=str) == sorted(many, key=str) and any(r[3] for r in few)

    alone = [(k, f"text {k} " * 20) for k in range(20_000)]
    twice = [(30_000 + k, f"text {k % 1500} {k % 1500} " * 20) for k in range(3000)]
    rows = spark.createDataFrame(alone + twice, "page_id long, payload string").withColumn(
        "payload_digest", F.sha2("payload", 256))
    first = rows.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    marked = warc.mark(rows, first, first.count()).where("marked")
    assert marked.where("page_id >= 30000").count() == 3000
    assert marked.count() < 3000 + 20_000 * 2 / warc.MARK_BITS

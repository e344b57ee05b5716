"""CSV files with quoted line ends, read in ranges, equal the single-task read."""

import random

import pytest
from pyspark.sql import types as T

from basketry.sources import files as S
from basketry.sources.csv_ranges import _lines, block_starts, read_records

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("note", T.StringType())])


def value(rng):
    bits = ["a", "bc ", '"', ",", "\n", "\r\n", "é", " ", "\U0001F600", "x" * 40]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(0, 7)))


def quoted(v):
    return '"' + v.replace('"', '""') + '"'


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(n)) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [64, 700])
def test_ranges_equal_the_single_task_read(spark, tmp_path, small_splits, end, split):
    rng = random.Random(len(end) + split)
    want = []
    folder = tmp_path / "in"
    folder.mkdir()
    for f in range(3):
        rows = [(1000 * f + k, value(rng), value(rng) if rng.random() < 0.8 else None) for k in range(rng.randrange(60, 120))]
        if f == 1:
            rows[20] = (1020, "long\n" * 400, 'ends with a quote"')       # over many splits
        want += rows
        text = end.join(["id,name,note"] + [f"{i},{quoted(a)},{'' if b is None else quoted(b)}" for i, a, b in rows])
        (folder / f"part-{f}.csv").write_bytes((text + (end if f else "")).encode())
    small_splits(split)
    assert _lines(spark, str(folder)).rdd.getNumPartitions() > 8
    got = sorted(map(tuple, S.csv_scan(spark, str(folder), SCHEMA).collect()))
    assert got == sorted(want)
    small_splits(10**9)
    single = S.csv_scan(spark, str(folder), SCHEMA, ranges=False)

    def plain(rows):                       # in files with CR LF, Spark's parser makes LF of those inside values as well
        return sorted(tuple(v.replace("\r\n", "\n") if isinstance(v, str) else v for v in r) for r in rows)
    assert plain(single.collect()) == plain(got)


def test_blank_lines_other_order_and_bad_values(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('note,id\n"two\nlines",1\n\nplain,x\n"",3\n,4')
    schema = T.StructType.fromDDL("id long, note string")
    rows = sorted(map(tuple, S.csv_scan(spark, str(path), schema).collect()), key=str)
    assert rows == sorted([(1, "two\nlines"), (None, "plain"), (3, ""), (4, None)], key=str)


def test_only_a_header_and_nothing(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,name,note\n")
    assert S.csv_scan(spark, str(path), SCHEMA).collect() == []
    assert [r["first"] for r in read_records(spark, str(path)).collect()] == [True]


def test_parities_follow_the_quotes_before_a_block(spark, tmp_path, small_splits):
    path = tmp_path / "in.csv"
    text = "a,b\n" + "".join(f'{k},"line one\nline ""two""\n{"z" * (k % 17)}"\n' for k in range(200))
    path.write_bytes(text.encode())
    small_splits(50)
    parities = block_starts(_lines(spark, str(path)))
    assert len(parities) > 20
    for (_, block), (odd, _) in parities.items():
        # a block begins with the line behind the first line end at or after its start
        begin = 0 if block == 0 else text.index("\n", block) + 1
        assert odd == text[:begin].count('"') % 2

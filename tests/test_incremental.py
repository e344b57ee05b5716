"""A landed table kept up to date: only touched partitions change, the rows equal a full rebuild."""

import datetime as dt
import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry import session as S
from basketry.sources import adapters as A
from basketry.sources import incremental as I

SCHEMA = T.StructType().add("orderId", "long").add("periodStart", "date").add("qty", "double")
DAY = dt.date(2024, 1, 1)


def week(k):
    return None if k is None else DAY + dt.timedelta(7 * k)


@pytest.fixture
def landed(tmp_path):
    return I.LandedTable(str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "manifest"), SCHEMA,
                         "periodStart", ("orderId",))


def put(spark, t, name, rows):
    """One file ``name``.parquet with rows (id, week, qty)."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    pathlib.Path(t.landing).mkdir(exist_ok=True)
    cols = list(zip(*[(i, week(k), q) for i, k, q in rows])) or [[], [], []]
    pq.write_table(pa.table({"orderId": pa.array(cols[0], pa.int64()), "periodStart": pa.array(cols[1], pa.date32()),
                             "qty": pa.array(cols[2], pa.float64())}), f"{t.landing}/{name}.parquet")


def state(t):
    """Digest and time of every data file, by partition folder."""
    out = {}
    for f in sorted(pathlib.Path(t.table).rglob("*.parquet")):
        out.setdefault(f.parent.name, []).append((f.name, hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_mtime_ns))
    return out


def check(spark, t):
    """The table holds exactly the rows of the landing folder."""
    got = sorted(map(tuple, I.read_landed(spark, t).collect()), key=str)
    want = spark.read.schema(SCHEMA).parquet(t.landing)
    assert got == sorted(map(tuple, want.collect()), key=str)


def test_only_touched_partitions_change(spark, landed):
    put(spark, landed, "a b%1+", [(1, 0, 1.0), (2, 1, 2.0), (3, None, 3.0)])
    put(spark, landed, "b", [(4, 1, 1.0), (5, 2, 2.0), (5, 2, 2.0)])
    assert I.refresh(spark, landed) == I.Refresh(2, 4)
    check(spark, landed)
    before = state(landed)
    assert I.refresh(spark, landed) == I.Refresh(0, 0) and state(landed) == before

    put(spark, landed, "c", [(6, 2, 5.0), (7, 3, 6.0)])                   # a new file
    assert I.refresh(spark, landed) == I.Refresh(1, 2)
    check(spark, landed)
    after = state(landed)
    assert set(after) - set(before) == {"periodStart=2024-01-22"}
    assert {k for k in before if before[k] != after[k]} == {"periodStart=2024-01-15"}

    put(spark, landed, "b", [(4, 1, 9.0)])                                # changed: week 2 loses its rows
    assert I.refresh(spark, landed) == I.Refresh(1, 2)
    check(spark, landed)
    assert state(landed)["periodStart=2024-01-01"] == before["periodStart=2024-01-01"]

    pathlib.Path(f"{landed.landing}/a b%1+.parquet").unlink()             # removed: two partitions go
    put(spark, landed, "empty", [])
    assert I.refresh(spark, landed) == I.Refresh(2, 3)
    check(spark, landed)
    assert set(state(landed)) == {"periodStart=2024-01-08", "periodStart=2024-01-15", "periodStart=2024-01-22"}


def test_restart_between_table_and_manifest(spark, landed):
    put(spark, landed, "a", [(1, 0, 1.0), (2, 1, 2.0)])
    I.refresh(spark, landed)
    put(spark, landed, "a", [(1, 0, 4.0)])
    I.refresh(spark, landed)
    check(spark, landed)
    pathlib.Path(f"{landed.manifest}/v=2/_SUCCESS").unlink()              # as if it had not committed
    assert I.refresh(spark, landed) == I.Refresh(1, 2)
    check(spark, landed)


def test_aggregate_by_partition(spark, landed):
    def per_period(rows):
        return rows.groupBy("periodStart").agg(F.sum("qty").alias("qty")).where("qty > 0")

    schema = T.StructType().add("qty", "double").add("periodStart", "date")
    t = I.LandedTable(**{**landed.__dict__, "spread": ()})
    put(spark, t, "a", [(1, 0, 1.0), (2, 1, 2.0), (3, None, 3.0)])
    I.refresh(spark, t, per_period)
    put(spark, t, "b", [(4, 1, -2.0), (5, 2, 2.0)])                       # week 1 no longer passes
    I.refresh(spark, t, per_period)
    got = sorted(map(tuple, I.read_landed(spark, t, schema).collect()), key=str)
    assert got == sorted([(1.0, week(0)), (3.0, None), (2.0, week(2))], key=str)


def test_no_files(spark, landed):
    pathlib.Path(landed.landing).mkdir()
    assert I.refresh(spark, landed) == I.Refresh(0, 0)
    assert I.read_landed(spark, landed).collect() == []


def test_period_filter_skips_folders(spark, landed):
    put(spark, landed, "a", [(k, k, 1.0) for k in range(5)])
    I.refresh(spark, landed)
    rows = I.read_landed(spark, landed).where(F.col("periodStart") >= F.lit(week(3)))
    assert rows.count() == 2
    assert len({f for f in rows.select("_metadata.file_path").distinct().toPandas()["file_path"]}) == 2


def test_large_refresh_in_passes(spark, landed, monkeypatch):
    """Passes over some of the partitions each give the rows of one, and leave no shuffle files."""
    monkeypatch.setattr(S, "SLICE_BYTES", 700)
    passes = []
    rewrite = I._rewrite
    monkeypatch.setattr(I, "_rewrite", lambda spark, t, held, some, *rest: passes.append(some) or rewrite(spark, t, held, some, *rest))
    rows = [(k, [0, 1, 2, 3, None][k % 5], float(k)) for k in range(60)]
    put(spark, landed, "a", rows)
    put(spark, landed, "b", rows)
    assert I.refresh(spark, landed) == I.Refresh(2, 5)
    check(spark, landed)
    assert len(passes) > 2 and sorted(sum(passes, []), key=str) == sorted({str(week(k)) if k is not None else None for k in (0, 1, 2, 3, None)}, key=str)
    del passes[:]
    before = state(landed)
    put(spark, landed, "c", [(100, 2, 1.0), (101, None, 2.0)])
    assert I.refresh(spark, landed) == I.Refresh(1, 2)
    check(spark, landed)
    assert len(passes) < 4 and {k for k, v in before.items() if state(landed)[k] == v} == \
        {f"periodStart={week(k)}" for k in (0, 1, 3)}


def shuffle_files(spark):
    return {str(f) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
            for f in pathlib.Path(d).rglob("shuffle_*.data")}


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    settings = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")}
    before = shuffle_files(spark)
    with S.short_lived_shuffles(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(-(-int(settings["spark.sql.shuffle.partitions"]) // 3))
        spark.range(2000).groupBy((F.col("id") % 100).alias("k")).count().write.parquet(str(tmp_path / "out"))
    assert shuffle_files(spark) <= before
    assert {k: spark.conf.get(k, None) for k in settings} == settings
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_order_items_in_shares(spark, monkeypatch):
    """Every row is in exactly one share, keys that repeat, are null or have no partner included."""
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(k, 1, 1, n, 1.0, 2.5, 0.0, 0.0, "N", "F", None) for k in [*range(30), 3, None, 99] for n in (1, 2, 2)]),
        "orders": ("o_orderkey int, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp",
                   [(k, 1, "F", 5.0, dt.datetime(2024, 1, 5)) for k in [*range(5, 40), 7, None]]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(1, "c", 1, "M")]),
        "nation": ("n_nationkey int, n_name string", [(1, "n")]),
        "part": ("p_partkey long, p_name string", [(1, "p")]),
        "supplier": ("s_suppkey long, s_name string", [(1, "s")]),
    }
    monkeypatch.setattr(A, "read_table", lambda spark, d, name: spark.createDataFrame(tables[name][1], tables[name][0]))
    monkeypatch.setattr(A, "_dimension", lambda spark, d, name, *cols: spark.createDataFrame(tables[name][1], tables[name][0]).select(*cols))
    whole = sorted(map(str, A.order_items(spark, "x").collect()))
    shares = [list(map(str, A.order_items(spark, "x", (k, 3)).collect())) for k in range(3)]
    assert min(map(len, shares)) > 0 and sorted(sum(shares, [])) == whole
    monkeypatch.setattr(A, "slices", lambda size, shuffles: 3)
    monkeypatch.setattr(A, "star_state", lambda spark, d: ())
    landed_rows = A.landed(spark, "test-shares", "x", A.order_items, cluster_by=["periodStart", "orderId"], shares=True)
    assert sorted(map(str, landed_rows.collect())) == whole

"""Incremental maintenance of a landed table: only what changed files touch is rewritten.

New, changed and removed files of a landing folder are found by comparing the
folder with a manifest of the files read so far (path, size, modification
time and the values of the partition column that each file holds). The
partitions that those files hold, or held, are recomputed from all files
that hold one of them, and written by dynamic partition overwrite; every
other partition stays byte for byte as it is.

A refresh may stop anywhere. The table is written before the manifest, each
by a Spark commit, so a refresh after a lost driver finds the same
files changed and rewrites the same partitions with the same rows. A manifest version
counts once its job has committed. One refresh of a table may run at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.session import short_lived_shuffles, slices

_MANIFEST = "path string, uri string, size long, modified timestamp, value string, has_rows boolean"
_FILE = ["uri", "size", "modified"]


@dataclass(frozen=True)
class LandedTable:
    """A table kept up to date from the Parquet files of a landing folder."""
    landing: str                 # files arrive, change and go here (any depth)
    table: str                   # the table, partitioned by ``column``
    manifest: str                # versions of the manifest
    schema: T.StructType         # of the landing files
    column: str                  # partition column
    spread: tuple[str, ...] = () # columns that split a partition holding very many rows


@dataclass(frozen=True)
class Refresh:
    """What a refresh did."""
    files: int                   # new, changed or removed files
    partitions: int              # partitions rewritten or removed


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _last_version(spark: SparkSession, manifest: str) -> int:
    """Number of the newest committed manifest, 0 if there is none."""
    fs, p = _folder(spark, manifest)
    if not fs.exists(p):
        return 0
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, "v=*/_SUCCESS"))
    return max((int(f.getPath().getParent().getName()[2:]) for f in found), default=0)


def _files(spark: SparkSession, t: LandedTable) -> DataFrame:
    """One row a landing file: path, uri, size, modified. Contents aren't read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").load(t.landing)
            .select("path", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("size"),
                    F.col("_metadata.file_modification_time").alias("modified")))


def _read(spark: SparkSession, t: LandedTable, paths: list[str]) -> DataFrame:
    return spark.read.schema(t.schema).parquet(*paths)


def _partition_text(t: LandedTable):
    return F.col(t.column).cast("string")


def refresh(spark: SparkSession, t: LandedTable,
            transform: Callable[[DataFrame], DataFrame] | None = None) -> Refresh:
    """Bring the table up to date with its landing folder.

    ``transform`` turns the rows of whole partitions into the table's rows
    (default: as they are). It must keep ``column`` and may combine rows of one
    partition only, such as an aggregate by period, because it sees
    only the partitions that changed.

    The paths of changed files, and of files that share a partition with
    them, pass the driver, as those of any read do. Defined cases: rows whose
    ``column`` is null have a partition of their own; a file without rows is
    recorded and changes nothing; a partition whose rows are all gone is
    removed; without any change nothing is written. A transform that returns
    no rows for a touched partition removes it as well.
    """
    version = _last_version(spark, t.manifest)
    old = spark.read.schema(_MANIFEST).parquet(f"{t.manifest}/v={version}") if version \
        else spark.createDataFrame([], _MANIFEST)
    now = _files(spark, t)
    # a changed file is both gone (its old state) and new
    new = now.join(old.select(*_FILE).distinct(), _FILE, "left_anti").select("path", *_FILE).collect()
    gone = old.join(now.select(*_FILE), _FILE, "left_anti")
    n_gone = gone.select("uri").distinct().count()
    if not new and not n_gone:
        return Refresh(0, 0)

    kept = old.join(now.select(*_FILE), _FILE, "left_semi")
    entries = kept
    if new:
        files = spark.createDataFrame([tuple(r) for r in new], "path string, uri string, size long, modified timestamp")
        held = (_read(spark, t, [r["path"] for r in new])
                .select(F.col("_metadata.file_path").alias("uri"), _partition_text(t).alias("value"))
                .distinct().withColumn("has_rows", F.lit(True)))
        added = files.join(held, "uri", "left").withColumn("has_rows", F.coalesce("has_rows", F.lit(False)))
        entries = kept.unionByName(added)
    next_manifest = f"{t.manifest}/v={version + 1}"
    staged = f"{t.manifest}/staged"
    entries.select("path", *_FILE, "value", "has_rows").write.mode("overwrite").parquet(staged)
    entries = spark.read.schema(_MANIFEST).parquet(staged)

    # partitions that a changed file holds or held, a value each
    changed = entries.join(old.select(*_FILE).distinct(), _FILE, "left_anti").unionByName(gone.select(entries.columns))
    touched = [r["value"] for r in changed.where("has_rows").select("value").distinct().collect()]
    if touched:
        held_now = entries.where("has_rows")
        left: set = set()
        # much is rewritten in several passes, each over some of the partitions and with its own shuffle files
        touched.sort(key=lambda v: (v is not None, v))
        # (a file counts with as much of its size as it holds of the partitions)
        size = held_now.groupBy("path").agg((F.first("size") * F.count_if(F.coalesce(_is_one_of(F.col("value"), touched), F.lit(False)))
                                             / F.count(F.lit(1))).alias("size")).agg(F.sum("size")).first()[0]
        n = min(slices(int(size or 0)), len(touched))
        for k in range(n):
            some = touched[k * len(touched) // n:(k + 1) * len(touched) // n]
            left |= _rewrite(spark, t, held_now, some, transform, n)
        for value in set(touched) - left:
            _remove_partition(spark, t, value)
    spark.read.schema(_MANIFEST).parquet(staged).write.mode("overwrite").parquet(next_manifest)
    return Refresh(len({r["uri"] for r in new} | {r["uri"] for r in gone.select("uri").distinct().collect()}),
                   len(touched))


def _is_one_of(column: Column, values: list) -> Column:
    """Null counts as a value. Literals are given as they are, so that the filter on a column reaches its scan."""
    some = [v for v in values if v is not None]
    found = column.isin(some) if some else F.lit(False)
    return found if len(some) == len(values) else found | column.isNull()


def _rewrite(spark: SparkSession, t: LandedTable, held: DataFrame, touched: list[str | None],
             transform: Callable[[DataFrame], DataFrame] | None, share: int) -> set:
    """Write the partitions ``touched`` anew from the files that hold them; which of them have rows."""
    mine = held.where(_is_one_of(F.col("value"), touched))
    paths = [r["path"] for r in mine.select("path").distinct().collect()]
    if not paths:
        return set()
    dtype = t.schema[t.column].dataType
    rows = _read(spark, t, paths).where(
        _is_one_of(F.col(t.column), [None if v is None else F.lit(v).cast(dtype) for v in touched]))
    rows = transform(rows) if transform else rows
    by = [t.column, *t.spread]
    with short_lived_shuffles(spark, share):
        (rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(t.column).parquet(t.table))
    left = {r["value"] for r in mine.select("value").distinct().collect()}
    if transform:
        left &= {r["value"] for r in rows.select(_partition_text(t).alias("value")).distinct().collect()}
    return left


def _remove_partition(spark: SparkSession, t: LandedTable, value: str | None) -> None:
    catalyst = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    name = catalyst.getPartitionPathString(t.column, value)
    fs, p = _folder(spark, f"{t.table}/{name}")
    fs.delete(p, True)


def read_landed(spark: SparkSession, t: LandedTable, schema: T.StructType | None = None) -> DataFrame:
    """The table (``schema``: of a transform's rows, if there is one), with its columns in order.

    Filters on the partition column skip whole folders.
    """
    schema = schema or t.schema
    fs, p = _folder(spark, t.table)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(t.table).select(*schema.names)

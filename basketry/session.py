"""Spark session and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. Timestamps are interpreted in UTC so that
# Spark and the DuckDB oracle agree; ANSI mode stays on (Spark 4 default).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ui.enabled": "false",
    "spark.ui.enabled": "false",
    # checkpoints of intermediates are removed once no plan refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "basketry") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    ``master`` and ``shuffle_partitions`` are only for local runs and tests;
    on a cluster leave them unset so the cluster configuration applies.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only for local masters.

    On a cluster ``spark.checkpoint.dir`` must name a folder that the driver
    and all executors share; without it this fails rather than write where
    executors can't read. Only a ``local`` master (tests, trial runs) gets a
    fresh folder under the system temp directory.
    """
    try:
        sc = spark.sparkContext
    except Exception:                    # Spark Connect: no SparkContext on the client
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors") from None
        return current
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        current = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


SCAN_BYTES = 16 << 20        # of a file read by one task, at most
SHUFFLE_BYTES = 4 << 20      # of the (compressed) input behind one shuffle partition


def size_tasks(spark: SparkSession, input_bytes: int) -> None:
    """Bound what one task reads, sorts or hashes, however large the input is.

    Scans are split at ``SCAN_BYTES``, and there are at least ``input_bytes /
    SHUFFLE_BYTES`` shuffle partitions, of which adaptive execution merges the
    small ones. With a fixed number of partitions a task's share grows with the
    input until sorts and hash tables spill. Larger numbers of partitions and
    smaller splits that are already set stay.
    """
    want = -(-input_bytes // SHUFFLE_BYTES)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < want:
        spark.conf.set("spark.sql.shuffle.partitions", str(want))
    key = "spark.sql.files.maxPartitionBytes"
    if _bytes(spark.conf.get(key)) > SCAN_BYTES:
        spark.conf.set(key, f"{SCAN_BYTES}b")


SLICE_BYTES = 1 << 30        # of input whose shuffle files are on disk at a time, where each row is shuffled once
MAX_SLICES = 8               # each slice scans the input once more


def slices(input_bytes: int, shuffles: int = 1) -> int:
    """In how many passes, over a share of the keys each, a job runs that shuffles its input so many times."""
    return max(1, min(MAX_SLICES, -(-input_bytes * shuffles // SLICE_BYTES)))


@contextmanager
def short_lived_shuffles(spark: SparkSession, share: int = 1) -> Iterator[None]:
    """Inside, a job's shuffle files are removed as it ends, not whenever the driver collects its garbage.

    ``share``: each job shuffles one part in so many, by as many partitions less.
    """
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    fewer = str(-(-int(partitions) // share))
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.shuffle.partitions": fewer}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _bytes(setting: str) -> int:
    """A size setting (``128MB``, ``16m``, ``1048576``) in bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (for per-application caches)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return spark.conf.get("spark.app.id", "app")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint folder, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(remove_scratch, spark)
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def remove_scratch(spark: SparkSession) -> None:
    """Remove every scratch path of this application (through Hadoop's file systems)."""
    paths, _SCRATCH[:] = _SCRATCH[:], []
    try:
        jvm = spark._jvm
        conf = jvm.org.apache.hadoop.conf.Configuration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    except Exception:                    # the JVM is gone: nothing can be removed any more
        pass


def input_state(spark: SparkSession, paths: list[str]) -> tuple:
    """(path, size, modification time) of every file at or below ``paths``.

    Tables derived from those files are kept under this key, so changed input
    is noticed.
    """
    try:
        jvm = spark._jvm
        conf = spark._jsparkSession.sessionState().newHadoopConf()
    except Exception:                    # Spark Connect
        return ()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))

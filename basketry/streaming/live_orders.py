"""Ingest of new order-item files with Structured Streaming, and a refresh of the period metrics.

New order-item files that land in a folder are picked up by a file source;
each micro-batch is added to the order-item table. The metrics are then
recomputed from the whole table (a customer's history reaches back over all
of it) and written as a new version; readers take the newest one.

The stream's checkpoint (in the shared folder) records which files were
consumed; a replayed batch rewrites the same batch-numbered folder of the item
table and the same version of the metrics, so a retry after the loss of an
executor or the driver gives the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.orders import order_metrics_by_period_type
from basketry.schemas import ORDER_ITEMS
from basketry.session import scratch_path


@dataclass
class LiveOrderPaths:
    landing: str        # new order-item Parquet files arrive here
    items: str          # accumulated order-item table (one folder per batch)
    metrics: str        # current metrics table
    checkpoint: str     # stream progress


def default_paths(spark: SparkSession, landing: str) -> LiveOrderPaths:
    base = scratch_path(spark, "live-orders")
    return LiveOrderPaths(landing, f"{base}/items", f"{base}/metrics", f"{base}/_checkpoint")


def _refresh(spark: SparkSession, paths: LiveOrderPaths, status: str | None, threshold: float):
    def run(batch: DataFrame, batch_id: int) -> None:
        # idempotent append: the folder is named by the batch id
        (batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{paths.items}/_batch={batch_id}"))
        items = spark.read.parquet(paths.items).drop("_batch")
        metrics = order_metrics_by_period_type(items, status, threshold)
        metrics.write.mode("overwrite").parquet(f"{paths.metrics}/v={batch_id}")
    return run


def run_live_orders(spark: SparkSession, paths: LiveOrderPaths, status: str | None = "F",
                    threshold: float = 100.0, max_files_per_trigger: int = 100) -> DataFrame:
    """Process every file now in ``paths.landing`` and return the latest metrics.

    Uses the ``availableNow`` trigger: all pending files are consumed in
    bounded micro-batches, then the query stops (schedule it to run again).
    """
    stream = (spark.readStream.schema(ORDER_ITEMS)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(paths.landing))
    q = (stream.writeStream.foreachBatch(_refresh(spark, paths, status, threshold))
         .option("checkpointLocation", paths.checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_metrics(spark, paths)


def latest_metrics(spark: SparkSession, paths: LiveOrderPaths) -> DataFrame:
    """The metrics written by the most recent batch."""
    all_versions = spark.read.parquet(paths.metrics)
    last = all_versions.agg(F.max("v")).first()[0]
    return spark.read.parquet(f"{paths.metrics}/v={last}")

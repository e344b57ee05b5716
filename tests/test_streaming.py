"""The live ingest gives the same metrics as the batch query over the same files."""

from pyspark.sql import functions as F

from basketry.operators.orders import order_metrics_by_period_type
from basketry.session import scratch_path
from basketry.sources.adapters import landed_order_items
from basketry.streaming.live_orders import default_paths, run_live_orders


def test_live_metrics_equal_batch(spark, sf_dir):
    items = landed_order_items(spark, sf_dir)
    paths = default_paths(spark, scratch_path(spark, "landing"))
    # two arrivals: orders with even keys first, then the rest
    items.where(F.col("orderId") % 2 == 0).write.parquet(paths.landing)
    first = run_live_orders(spark, paths, "F", 250000.0, max_files_per_trigger=2)
    assert first.count() > 0
    items.where(F.col("orderId") % 2 == 1).write.mode("append").parquet(paths.landing)
    live = run_live_orders(spark, paths, "F", 250000.0, max_files_per_trigger=2)
    batch = order_metrics_by_period_type(items, "F", 250000.0)
    a = sorted(map(tuple, live.select(*batch.columns).collect()))
    b = sorted(map(tuple, batch.collect()))
    assert a == b

"""Changes that come close after each other, gathered until it is quiet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(changes: DataFrame, keys: list[str], at: str, path: str, gap_seconds: int) -> DataFrame:
    """``keys, started, n_changes, n_paths`` of stored changes: a longer gap begins a new session."""
    order = Window.partitionBy(*keys).orderBy(at, path)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1_000_000)
    begins = F.when(F.coalesce(F.col("_s") - F.lag("_s").over(order) > gap_seconds, F.lit(True)), F.col(at))
    rows = changes.withColumn("_s", seconds).withColumn("_b", begins)
    rows = rows.withColumn("started", F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "started").agg(F.count("*").alias("n_changes"), F.count_distinct(path).alias("n_paths"))


def session_stream(changes: DataFrame, keys: list[str], at: str, path: str, gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """The same over a stream, as session windows of each key with their distinct paths."""
    return (
        changes.withWatermark(at, late)
        .groupBy(*keys, F.session_window(at, gap).alias("window"))
        .agg(F.array_sort(F.collect_set(path)).alias("paths"), F.count("*").alias("n_changes"))
    )

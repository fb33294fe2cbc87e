"""Incremental ledger ingestion: batches are validated, deduplicated and merged into a projection."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ledger as G


def project(known: DataFrame, batch: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """The projection after a batch: new events by id, erased ones kept out, of repeats the latest status.

    An erased event that is known already goes. An id that is known keeps the later status of both; events that arrive late are taken like
    any other. ``valid_to`` is the earliest time at which a successor began.
    """
    latest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in batch.columns]), F.struct(F.coalesce(G.rank(F.col("status"), G.STATUS_RANK), F.lit(0)), "created_at"))
    new = batch.groupBy(F.col("id").alias("_id")).agg(latest.alias("_row")).select("_row.*")
    if tombstones is not None:
        erased = tombstones.select("id").distinct()
        new, known = new.join(erased, "id", "left_anti"), known.join(erased, "id", "left_anti")
    columns = [c for c in known.columns if c != "valid_to"]
    both = known.select(*columns).join(new.select("id", F.col("status").alias("_s")), "id", "left")
    old = both.withColumn("status", G.merged_status(F.col("status"), F.col("_s"))).select(*columns)
    events = old.unionByName(new.select(*columns).join(known.select("id"), "id", "left_anti"))
    ends = G.references(events, "created_at").groupBy(F.col("target").alias("id")).agg(F.min("created_at").alias("valid_to"))
    return events.join(ends, "id", "left").select(*columns, "valid_to")


def is_no_op(known: DataFrame, batch: DataFrame, tombstones: DataFrame | None = None) -> bool:
    """Whether a batch holds nothing but known events in a status that they have or are past, and nothing known is erased."""
    if tombstones is not None and not known.join(tombstones.select("id"), "id", "left_semi").isEmpty():
        return False
    both = batch.select("id", F.col("status").alias("_s")).join(known.select("id", "status"), "id", "left")
    return both.where("status IS NULL").isEmpty() and both.where(G.merged_status(F.col("status"), F.col("_s")) != F.col("status")).isEmpty()


def newest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest version of the table, or of those before a number; None if there is none."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException:
        return None
    found = versions if below is None else versions.where(F.col("version") < below)
    last = found.agg(F.max("version")).first()[0]
    return None if last is None else spark.read.parquet(f"{path}/version={last}")


def sync(stream: DataFrame, path: str, checkpoint: str, tombstones: DataFrame | None = None) -> StreamingQuery:
    """Merge a stream of events into versions of a table under ``path``; one version a batch that changes something.

    A replayed batch writes the version of its number again, so a restart changes nothing, and
    one whose events are all known writes none. The newest version is the projection.
    """

    def merge(batch: DataFrame, number: int) -> None:
        known = newest(batch.sparkSession, path, number)
        if known is None:
            known = batch.limit(0).withColumn("valid_to", F.lit(None).cast(batch.schema["created_at"].dataType))
        elif is_no_op(known, batch, tombstones):
            return
        project(known, batch, tombstones).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batched_writes(stream: DataFrame, path: str, checkpoint: str, every: str = "100 milliseconds") -> StreamingQuery:
    """Append a stream in small batches, as a bounded write queue would."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

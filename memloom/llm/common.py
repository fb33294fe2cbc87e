"""What the operators share: reading tables, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder. Where none is named, a local run gets a folder of its own and a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="memloom-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Spark deletes the shuffle files of steps before earlier checkpoints once the driver has
    collected its garbage; many small steps don't fill its memory, so it is told to.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """``df``, written to the shared checkpoint folder as Parquet and read again.

    For tables with texts: they are compressed there, and a reader takes only the columns it needs.
    As in :func:`checkpoint`, shuffle files of earlier steps are let go first.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    spark.sparkContext._jvm.System.gc()
    path = f"{spark.sparkContext.getCheckpointDir()}/saved-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(offsets.searchsorted(offsets[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def text_buffers(column: pa.Array):
    """The UTF-8 bytes of a string column and where each row begins; null counts as empty."""
    import numpy as np

    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind) if offsets is not None else np.zeros(1, kind)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lookup(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; beyond that joins shuffle.

    For tables of a few numbers a row only, so that the bound holds for their bytes too.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

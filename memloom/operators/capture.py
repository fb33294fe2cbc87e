"""Captured tool calls as episodes: normalised observations, bounded sessions, drafts of procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The arguments that may be kept, and how many observations and episodes are held.
ALLOWED = ("path", "file_path", "command", "pattern", "url")
MOST_OBSERVATIONS = 128
MOST_EPISODES = 32


def observations(calls: DataFrame) -> DataFrame:
    """``id, provider, session_id, tool, ordinal, status, arguments, redacted``.

    ``calls`` has ``provider, session_id, call_id, tool, ordinal, status, arguments`` (a map).
    Only allowed arguments stay; how many were left out is counted. A repeated call counts once.
    """
    kept = F.map_filter("arguments", lambda k, v: k.isin(*ALLOWED))
    named = calls.withColumn("id", F.sha2(F.concat_ws("\u0000", "provider", "session_id", "call_id"), 256))
    first = named.groupBy("id").agg(F.min_by(F.struct("provider", "session_id", "tool", "ordinal", "status", "arguments"), "ordinal").alias("r"))
    rows = first.select("id", "r.*")
    return rows.withColumns({"redacted": F.size("arguments") - F.size(kept), "arguments": kept})


def bounded(found: DataFrame) -> DataFrame:
    """The newest episodes of each provider, each with its newest observations; the bounds are the feature."""
    per = Window.partitionBy("provider", "session_id").orderBy(F.desc("ordinal"), F.asc("id"))
    kept = found.withColumn("k", F.row_number().over(per)).where(F.col("k") <= MOST_OBSERVATIONS).drop("k")
    last = found.groupBy("provider", "session_id").agg(F.max("ordinal").alias("last"))
    newest = Window.partitionBy("provider").orderBy(F.desc("last"), F.asc("session_id"))
    sessions = last.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= MOST_EPISODES).select("provider", "session_id")
    return kept.join(sessions, ["provider", "session_id"], "left_semi")


def summary(found: DataFrame) -> DataFrame:
    """``provider, session_id`` with counts of observations, outcomes and arguments left out."""
    return found.groupBy("provider", "session_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"),
        F.sum("redacted").cast("long").alias("n_redacted"),
    )


def draft_sources(found: DataFrame, blobs: DataFrame, current: DataFrame) -> DataFrame:
    """``path, blob, changed``: the latest blob captured of each path that was touched, and whether it has changed since.

    ``blobs`` has ``path, ordinal, blob``; ``current`` has ``path, blob``.
    """
    touched = found.select(F.coalesce(F.element_at("arguments", F.lit("path")), F.element_at("arguments", F.lit("file_path"))).alias("path")).where("path IS NOT NULL").distinct()
    last = blobs.groupBy("path").agg(F.max_by("blob", "ordinal").alias("blob"))
    now = current.select("path", F.col("blob").alias("now"))
    return touched.join(last, "path").join(now, "path", "left").select("path", "blob", (~F.col("blob").eqNullSafe(F.col("now"))).alias("changed"))

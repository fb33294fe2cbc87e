"""Procedures written: learned from drafts, approved by people, and reported on; each write is idempotent by its receipt.

Every function judges a batch against the events that are there and within itself, and returns
the events to append and a verdict for each request: "written", "known" where the same receipt
holds the same content already, else the first rule that is broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Who may report, what may be kept in a repository's ledger, what an outcome may be.
REPORTERS = ("human", "agent")
OPEN = ("public", "internal")
OUTCOMES = ("success", "failure", "unknown")


def _judged(requests: DataFrame, known: DataFrame, rule: Column, *content: str) -> DataFrame:
    """``requests`` with ``digest`` and ``verdict``; of requests with one receipt the first counts, if it breaks no rule."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    held = known.groupBy("receipt_id").agg(F.min("digest").alias("_held"))
    rows = requests.withColumn("digest", digest).withColumn("_rule", rule).join(held, "receipt_id", "left")
    fresh = F.col("_rule").isNull() & F.col("_held").isNull()
    order = Window.partitionBy("receipt_id", fresh).orderBy("created_at", "request_id")
    rows = rows.withColumns({"_first": F.first("digest").over(order), "_place": F.row_number().over(order)})
    verdict = (
        F.when(F.col("_held") == F.col("digest"), "known").when(F.col("_held").isNotNull(), "receipt was used")
        .when(F.col("_rule").isNotNull(), F.col("_rule")).when(F.col("_place") == 1, "written")
        .when(F.col("_first") == F.col("digest"), "known").otherwise("receipt was used")
    )
    return rows.withColumn("verdict", verdict).drop("_rule", "_held", "_first", "_place")


def learned(drafts: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """``request_id, receipt_id, digest, verdict`` of drafts of procedures.

    ``drafts`` has ``request_id, receipt_id, title, steps, path, start_line, end_line, authority,
    sensitivity, created_at``; ``files`` (``path, lines``) are those that may be cited; ``events``
    (``receipt_id, digest``) what was written before.
    """
    there = files.select("path", "lines")
    rows = drafts.join(there, "path", "left")
    rule = (
        F.when(F.col("lines").isNull(), "no such source").when(F.col("end_line") < F.col("start_line"), "lines out of order")
        .when(F.greatest("start_line", "end_line") > F.col("lines"), "lines beyond the source").when(~F.col("authority").isin(*REPORTERS), "no reporter")
        .when(~F.col("sensitivity").isin(*OPEN), "sensitive").when(F.size("steps") == 0, "no steps")
    )
    return _judged(rows, events, rule, "title", "steps", "path", "start_line", "end_line").select("request_id", "receipt_id", "digest", "verdict")


def approved(approvals: DataFrame, procedures: DataFrame, files: DataFrame, events: DataFrame) -> DataFrame:
    """``request_id, receipt_id, procedure_id, digest, verdict`` of approvals.

    ``approvals`` has ``request_id, receipt_id, procedure_id, authority, created_at``;
    ``procedures`` ``id, state, active, path, blob``; ``files`` ``path, sha256``. Only people
    approve, and only an active candidate whose source is still what was learned; the approved
    version supersedes it, so of several approvals of one candidate the first counts.
    """
    target = procedures.select(F.col("id").alias("procedure_id"), "state", "active", "path", "blob")
    rows = approvals.join(target, "procedure_id", "left").join(files.select("path", F.col("sha256").alias("_now")), "path", "left")
    rule = (
        F.when(F.col("state").isNull(), "no such procedure").when(F.col("authority") != "human", "needs human authority")
        .when(F.col("state") != "candidate", "not a candidate").when(~F.col("active"), "no longer active")
        .when(F.col("blob").isNull() | ~F.col("blob").eqNullSafe(F.col("_now")), "source has changed")
    )
    judged = _judged(rows, events, rule, "procedure_id", "authority")
    written = F.col("verdict") == "written"
    order = Window.partitionBy("procedure_id", written).orderBy("created_at", "request_id")
    late = written & (F.row_number().over(order) > 1)
    return judged.withColumn("verdict", F.when(late, "approved before").otherwise(F.col("verdict"))).select("request_id", "receipt_id", "procedure_id", "digest", "verdict")


def reported(outcomes: DataFrame, procedures: DataFrame, events: DataFrame) -> DataFrame:
    """``request_id, receipt_id, kind, digest, verdict`` of outcomes of approved procedures.

    ``outcomes`` has ``request_id, receipt_id, episode_id, procedure_id, outcome, verified,
    evidence, authority, sensitivity, created_at``; ``procedures`` ``id, state, created_at``;
    ``events`` ``receipt_id, episode_id, digest``. A success needs a verification that passed, a
    failure evidence and is kept as a mistake; an episode has one receipt.
    """
    target = procedures.select(F.col("id").alias("procedure_id"), "state", F.col("created_at").alias("_born"))
    told = events.groupBy("episode_id").agg(F.min("receipt_id").alias("_receipt"))
    rows = outcomes.join(target, "procedure_id", "left").join(told, "episode_id", "left")
    mine = F.first("receipt_id").over(Window.partitionBy("episode_id").orderBy("created_at", "request_id"))
    rows = rows.withColumn("_mine", F.coalesce("_receipt", mine))
    rule = (
        F.when(~F.coalesce(F.col("state") == "approved", F.lit(False)), "no approved version").when(F.col("created_at") < F.col("_born"), "predates its version")
        .when(~F.col("authority").isin(*REPORTERS) | ~F.col("sensitivity").isin(*OPEN), "no open report").when(~F.col("outcome").isin(*OUTCOMES), "no such outcome")
        .when((F.col("outcome") == "success") & ~F.coalesce("verified", F.lit(False)), "not verified").when((F.col("outcome") == "failure") & F.coalesce(F.trim("evidence") == "", F.lit(True)), "no evidence")
        .when(F.col("_mine") != F.col("receipt_id"), "episode has another receipt")
    )
    judged = _judged(rows, events, rule, "episode_id", "procedure_id", "outcome", "verified", "evidence")
    return judged.select("request_id", "receipt_id", F.when(F.col("outcome") == "failure", "mistake").otherwise("fact").alias("kind"), "digest", "verdict")

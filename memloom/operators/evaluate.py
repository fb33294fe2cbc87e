"""How good retrieval is: precision, recall, reciprocal rank, discounted gain, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame, keys: Sequence[str], cuts: Sequence[int] = (5, 10), gain_at: int = 10) -> DataFrame:
    """Per query precision and recall at the cuts, reciprocal rank and normalised gain, binary.

    ``retrieved`` has ``keys, item, place`` (from 1), ``relevant`` has ``keys, item``. A query
    without relevant items has full recall and no gain.
    """
    good = relevant.select(*keys, "item").distinct()
    counts = good.groupBy(*keys).agg(F.count("*").alias("n_relevant"))
    marked = retrieved.join(good.withColumn("hit", F.lit(1)), [*keys, "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return marked_metrics(marked, counts, keys, cuts, gain_at)


def marked_metrics(marked: DataFrame, counts: DataFrame, keys: Sequence[str], cuts: Sequence[int] = (5, 10), gain_at: int = 10) -> DataFrame:
    """``retrieval_metrics`` where relevant items are known by a mark, so that not all of them are listed.

    ``marked`` has ``keys, item, place, hit`` (0 or 1), ``counts`` has ``keys, n_relevant``.
    """
    gain = F.when((F.col("hit") == 1) & (F.col("place") <= gain_at), 1 / F.log2(F.col("place") + 1)).otherwise(0.0)
    sums = marked.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("place") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in cuts],
        F.min(F.when(F.col("hit") == 1, F.col("place"))).alias("first"),
        F.sum(gain).alias("dcg"),
    )
    joined = sums.join(counts, list(keys), "left").fillna(0, ["n_relevant"])
    n = F.least(F.col("n_relevant"), F.lit(gain_at)).cast("int")
    ideal = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    return joined.select(
        *keys,
        *[(F.col(f"h{k}") / k).alias(f"precision_{k}") for k in cuts],
        *[F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.col(f"h{k}") / F.col("n_relevant")).alias(f"recall_{k}") for k in cuts],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias(f"ndcg_{gain_at}"),
    )


def drift(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """One row ``drift``: the mean of one minus the cosine of old and new embeddings."""
    return pairs.agg(F.avg(1 - V.cosine(F.col(before), F.col(after))).alias("drift"))


def cold_start(cases: DataFrame) -> DataFrame:
    """``cases`` with the recall of entities and decisions and the quality of the summary.

    Needs arrays ``expected_entities, entities, expected_decisions, decisions`` and ``summary,
    summary_terms``. A quality above a half counts as full.
    """
    share = lambda want, have: F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, have)) / F.size(F.array_distinct(want)))
    found = F.size(F.filter("summary_terms", lambda t: F.contains(F.lower("summary"), F.lower(t)))) / F.greatest(F.size("summary_terms"), F.lit(1))
    return cases.withColumns(
        {"entity_recall": share("expected_entities", "entities"), "decision_recall": share("expected_decisions", "decisions"),
         "summary_quality": F.when(found > 0.5, 1.0).otherwise(found)}
    )

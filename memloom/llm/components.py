"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


#: Links that a task reads. So many or fewer are one task's, and a round over them needs no shuffle.
LINKS_A_TASK = 100_000


def _round(edges: DataFrame, tasks: int) -> DataFrame:
    """One large and one small star. Both ends of a link come from one row, so that links of one task stay there."""
    edges = edges.coalesce(tasks)
    ends = lambda *pairs: F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs]))
    both = edges.select(ends(("u", "v"), ("v", "u")).alias("_")).select("_.u", "_.v")
    lowest = both.groupBy("u").agg(F.min("v").alias("m"))
    large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct().coalesce(tasks)
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").select(ends(("v", "m"), ("u", "m")).alias("_")).select("_.u", "_.v")
    return small.where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """The smallest id reachable from each id that has a link.

    ``links`` has the long columns ``a`` and ``b``. Returns ``id, component``. Links of an id
    to itself and links with a null end count for nothing; repeated links count once. Each
    round joins and groups by key, so a hub's links are never gathered in one row.
    """
    edges = checkpoint(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before, n = None, edges.count()
    for _ in range(rounds):
        edges = checkpoint(_round(edges, 1 + n // LINKS_A_TASK))
        after = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if after == before:
            break
        before, n = after, after["n"]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def bucket_links(
    met: DataFrame, confirm: Callable[[DataFrame], DataFrame], among: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Links ``a, b`` that have the same components as all true links within buckets.

    ``met`` has ``bucket, node`` (long); ``confirm`` keeps the true links among pairs ``a < b``.
    In each bucket all nodes are first held against one hub, the node that meets most others
    anywhere, so that a group of n copies costs n pairs. A pair inside a component changes
    nothing, so what is left are buckets whose nodes are still in different components: these go
    to ``among`` (``bucket, node, component`` to links), whatever their number.
    """
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = met.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("weight"))
    hub = (
        met.join(weight, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", (-F.col("node")).alias("least"))).alias("top"))
        .select("bucket", (-F.col("top.least")).alias("hub"))
    )
    star = checkpoint(met.join(hub, "bucket").where("node <> hub").select(*ordered("node", "hub")).distinct())
    linked = checkpoint(confirm(star))
    labelled = met.join(components(linked).withColumnRenamed("id", "node"), "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    split = (
        labelled.groupBy("bucket")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo < hi")
        .select("bucket")
    )
    left = checkpoint(labelled.join(split, "bucket", "left_semi"))
    return linked if left.isEmpty() else linked.union(among(left))

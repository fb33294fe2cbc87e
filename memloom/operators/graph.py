"""Graph operators over ``src, dst`` (and ``weight``) edges, as joins and grouped sums.

Loops only steer: each step is a join whose result is written to the checkpoint folder, so that
no step is computed twice, lineage stays short and a lost executor costs a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import saved

DAMPING = 0.85


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = DAMPING, tolerance: float | None = None) -> DataFrame:
    """``id, rank``: weighted PageRank, dangling mass spread evenly, ranks adding up to 1.

    Runs ``iterations`` rounds, or fewer once the ranks move by less than ``tolerance`` in all.
    """
    weight = F.greatest(F.col("weight"), F.lit(0.0)) if "weight" in edges.columns else F.lit(1.0)
    flat = edges.select("src", "dst", weight.alias("w")).where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = flat.groupBy("src").agg(F.sum("w").alias("total"))
    share = saved(flat.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    linked = out.select(F.col("src").alias("id"), F.lit(True).alias("links"))
    ranks = saved(nodes.select("id").join(linked, "id", "left").select("id", F.coalesce("links", F.lit(False)).alias("links"), F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations):
        dangling = ranks.where("NOT links").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d")).first()["d"]
        given = share.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("in"))
        base = (1 - damping) / n + damping * dangling / n
        new = ranks.join(given, "id", "left").select("id", "links", F.col("rank").alias("before"), (F.lit(base) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        new = saved(new)
        if tolerance is not None and (new.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0) < tolerance:
            ranks = new.drop("before")
            break
        ranks = new.drop("before")
    total = ranks.agg(F.sum("rank")).first()[0] or 1.0
    return ranks.select("id", (F.col("rank") / F.lit(total)).alias("rank"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, n_in, n_out, n_any, centrality``: distinct neighbours, and their share of the other nodes."""
    n = nodes.count()
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("o"), F.lit(1).alias("out")).unionByName(
        edges.select(F.col("dst").alias("id"), F.col("src").alias("o"), F.lit(0).alias("out"))
    ).distinct()
    pairs = both.groupBy("id", "o").agg(F.max("out").alias("out"), F.min("out").alias("least"))
    sums = pairs.groupBy("id").agg(F.count_if(F.col("least") == 0).alias("n_in"), F.sum("out").cast("long").alias("n_out"), F.count("*").alias("n_any"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("id").join(sums, "id", "left").select("id", zero("n_in"), zero("n_out"), zero("n_any")).withColumn(
        "centrality", F.col("n_any") / F.lit(max(1, n - 1))
    )


def weak_components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component``: the smallest id that each node is connected with.

    In each round a node takes the smallest label around it, then its label's own label.
    """
    both = saved(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = saved(nodes.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("further"))
        step = saved(step.join(jump, "new", "left").select("id", "label", F.coalesce("further", "new").alias("new")))
        if step.where("label <> new").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        labels = step.select("id", F.col("new").alias("label"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def reached(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """``id, depth, parent`` of the nodes within ``hops`` of the seeds.

    The parent is the smallest id that reaches a node at its depth. The walk ends early when
    nothing new is found.
    """
    steps = _steps(edges, direction)
    found = saved(seeds.select("id").distinct().select("id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent")))
    front = found
    for depth in range(1, hops + 1):
        new = (
            front.select(F.col("id").alias("src")).join(steps, "src")
            .groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
            .join(found.select("id"), "id", "left_anti")
            .select("id", F.lit(depth).cast("long").alias("depth"), "parent")
        )
        front = saved(new)
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: str, hops: int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """The nodes within ``hops`` of a known start, and the edges walked to or back between them."""
    near = reached(edges, nodes.where(F.col("id") == start), hops, direction)
    inner = near.where(F.col("depth") < hops).select("id")
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    touched = None
    for end in ends:
        part = edges.join(inner.withColumnRenamed("id", end), end, "left_semi").select(*edges.columns)
        touched = part if touched is None else touched.unionByName(part)
    return near.select("id", "depth"), touched.distinct()


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str, direction: str = "both", most: int = 30) -> list[str] | None:
    """The first path by smallest parents; None if an end is unknown or out of reach.

    The result is one path, so it is put together on the driver, one lookup for each of its steps.
    """
    if nodes.where(F.col("id").isin(start, end)).select("id").distinct().count() < len({start, end}):
        return None
    found = reached(edges, nodes.where(F.col("id") == start), most, direction)
    path, at = [end], end
    while at != start:
        row = found.where(F.col("id") == at).first()
        if row is None:
            return None
        at = row["parent"]
        path.append(at)
    return path[::-1]


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose ends are among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def induced_at(nodes: DataFrame, edges: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph as it was at a time.

    ``nodes`` has ``id, valid_from, valid_to``; a node holds from ``valid_from`` (always, where
    that is missing) and before ``valid_to``. An edge is there with both of its ends, if its own
    ``effective_at``, where it has one, isn't later.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    kept = nodes.where((F.col("valid_from").isNull() | (F.col("valid_from") <= now)) & (F.col("valid_to").isNull() | (F.col("valid_to") > now)))
    begun = edges.where("effective_at IS NULL OR effective_at <= " + f"TIMESTAMP_NTZ '{as_of}'") if "effective_at" in edges.columns else edges
    return kept, induced(kept, begun)


def graph_score(ranks: DataFrame, degrees: DataFrame) -> DataFrame:
    """``id, graph_score``: 25 times the rank and 10 times the degree centrality."""
    return ranks.join(degrees, "id").select("id", (25 * F.col("rank") + 10 * F.col("centrality")).alias("graph_score"))

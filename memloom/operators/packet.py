"""Context packets: typed candidates scored against a query, boosted along the graph, packed by bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing in a query.
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "into", "how", "what", "where", "when", "does", "is", "are", "to", "of", "in", "on")
#: By type the score of an exact path or id, of an exact name, and of each shared token.
POINTS = {"file": (1000, 900, 45), "symbol": (950, 850, 55), "command": (900, 825, 50), "env": (825, 825, 50), "memory": (1100, 800, 60)}
NEIGHBOUR = 20.0
HIDDEN = ("confidential", "restricted")


def tokens(text: Column) -> Column:
    """Distinct lower-cased tokens of two characters or more, stop words left out, with light stems."""
    raw = F.filter(
        F.split(F.lower(text), "[^a-z0-9_./:@-]+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)
    )
    stem = lambda t: F.when((F.length(t) >= 8) & t.endswith("ion"), F.substring(t, F.lit(1), F.length(t) - 3)).when(
        (F.length(t) >= 6) & t.endswith("e"), F.substring(t, F.lit(1), F.length(t) - 1)
    )
    return F.array_distinct(F.concat(raw, F.array_compact(F.transform(raw, stem))))


def scored(candidates: DataFrame, query: str, graph_scores: DataFrame | None = None) -> DataFrame:
    """``candidates`` with ``exact`` (2 for id or path, 1 for name, else 0), ``overlap`` and ``score``.

    Needs ``id, type, path, name, text``; memories may have ``importance`` and ``confidence``.
    """
    asked = tokens(F.lit(query))
    low = query.strip().lower()
    exact = F.when(F.lower(F.coalesce("path", "id")) == low, 2).when(F.lower("name") == low, 1).otherwise(0)
    shared = F.size(F.array_intersect(tokens(F.concat_ws(" ", "path", "name", "text")), asked))
    score = F.lit(0.0)
    for kind, (by_id, by_name, each) in POINTS.items():
        points = F.when(exact == 2, by_id).when(exact == 1, by_name).otherwise(0) + each * shared
        score = score + F.when(F.col("type") == kind, points.cast("double")).otherwise(0.0)
    if "importance" in candidates.columns:
        extra = 30 * F.coalesce("importance", F.lit(0.0)) + 15 * F.coalesce("confidence", F.lit(0.0))
        score = score + F.when((F.col("type") == "memory") & ((exact > 0) | (shared > 0)), extra).otherwise(0.0)
    out = candidates.withColumns({"exact": exact, "overlap": shared, "score": score})
    if graph_scores is not None:
        out = out.join(graph_scores, "id", "left").withColumn("score", F.col("score") + F.coalesce("graph_score", F.lit(0.0))).drop("graph_score")
    return out


def boosted(found: DataFrame, near: DataFrame) -> DataFrame:
    """``found`` with 20 more for what is near a seed without being one; ``near`` has ``id, depth``."""
    marks = near.groupBy("id").agg(F.min("depth").alias("_d"))
    more = F.when((F.col("_d") > 0) & (F.col("exact") == 0), NEIGHBOUR).otherwise(0.0)
    return found.join(marks, "id", "left").withColumn("score", F.col("score") + F.coalesce(more, F.lit(0.0))).withColumn("near", F.col("_d").isNotNull()).drop("_d")


def visible(found: DataFrame, include_sensitive: bool = False) -> DataFrame:
    """What may be shown and has a reason to be: relevant, exact or near a seed."""
    ok = (F.col("exact") > 0) | (F.col("overlap") > 0) | F.coalesce(F.col("near"), F.lit(False))
    if not include_sensitive and "sensitivity" in found.columns:
        ok = ok & ~F.coalesce(F.col("sensitivity").isin(*HIDDEN), F.lit(False))
    return found.where(ok)


def packed(found: DataFrame, group: Sequence[str], max_characters: int, max_tokens: int, most: int = 200) -> DataFrame:
    """``group, packet, n_items``: rendered items in order of score until the bytes are used up.

    The first item that doesn't fit is clipped to what is left and ends the packet. A packet is
    small, so the best ``most`` of a group are cut out before they are gathered.
    """
    budget = min(max_characters, 4 * max_tokens)
    order = Window.partitionBy(*group).orderBy(F.desc("exact"), F.desc("score"), F.asc("type"), F.asc("id"))
    block = F.concat(F.lit("## "), F.col("type"), F.lit(" "), F.coalesce("name", "id"), F.lit("\n> "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n> "), F.lit("\nSource: "), F.coalesce("path", "id"), F.lit("\n"))
    rows = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select(*group, F.struct("k", block.alias("b")).alias("x"))
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(at: Column, x: Column) -> Column:
        left = F.lit(budget) - F.octet_length(at["t"])
        fits = at["open"] & (F.octet_length(x["b"]) <= left)
        # whole characters only: a clipped text is cut again where its bytes end within one
        clip = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(x["b"], "UTF-8"), F.lit(1), left).cast("string")), "�+$", "")
        part = at["open"] & ~fits & (left > 0)
        piece = F.when(fits, x["b"]).when(part, clip).otherwise("")
        return F.struct(F.concat(at["t"], piece).alias("t"), (at["n"] + F.when(fits | part, 1).otherwise(0)).alias("n"), fits.alias("open"))

    done = rows.groupBy(*group).agg(F.array_sort(F.collect_list("x")).alias("xs")).withColumn("p", F.aggregate("xs", start, step))
    return done.select(*group, F.col("p.t").alias("packet"), F.col("p.n").cast("long").alias("n_items"))

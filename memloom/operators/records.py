"""Compositions over records: views, derived keys, relations, inspection, lookups, memory graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import induced, reached
from .ledger import active_heads

MOST_HOPS = 5
MOST_DIRTY = 200
SENSITIVE = ("confidential", "restricted")


def view(events: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The heads of a group of kinds that may be shown, the most important first, then by title and id."""
    heads = active_heads(events).where(F.col("kind").isin(*kinds))
    shown = heads.where(~F.coalesce(F.col("sensitivity").isin(*SENSITIVE), F.lit(False)))
    return shown.orderBy(F.desc("importance"), F.asc("title"), F.asc("id"))


def derived_keys(repository: Column, subject: Column, sources: Column) -> Column:
    """Sorted distinct entity keys of an event: its repository, subject, files and symbols.

    ``sources`` is an array of structs of path and symbol.
    """
    files = F.transform(sources, lambda s: F.concat(F.lit("file:"), s["path"]))
    symbols = F.transform(
        F.filter(sources, lambda s: s["symbol"].isNotNull()), lambda s: F.concat(F.lit("symbol:"), s["path"], F.lit("#"), s["symbol"])
    )
    own = F.array(F.concat(F.lit("repo:"), repository), F.concat(F.lit("subject:"), subject))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(own, files, symbols))))


def related_once(relations: DataFrame, records: DataFrame) -> DataFrame:
    """Relations without repeats, both of whose ends are records of one tenant."""
    end = lambda x: records.select(F.col("memory_id").alias(x), F.col("tenant_id").alias(f"_{x}"))
    joined = relations.join(end("src"), "src").join(end("dst"), "dst").where("_src = _dst")
    return joined.select(*relations.columns).dropDuplicates(["src", "dst", "relation"])


def superseded(records: DataFrame, changes: DataFrame, held: DataFrame) -> DataFrame:
    """``records`` after new ones supersede old ones of the same tenant, both active and the old not held.

    ``changes`` has ``memory_id`` (the new) and ``supersedes`` (the old).
    """
    new = changes.join(records.select("memory_id", F.col("tenant_id").alias("_t"), F.col("status").alias("_s")), "memory_id")
    old = new.where("_s = 'active'").select(F.col("supersedes").alias("memory_id"), "_t").distinct()
    free = old.join(held.select("memory_id").distinct(), "memory_id", "left_anti")
    joined = records.join(free, "memory_id", "left")
    hit = (F.col("status") == "active") & F.coalesce(F.col("_t") == F.col("tenant_id"), F.lit(False))
    return joined.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).select(*records.columns).distinct()


def inspection(records: DataFrame, logs: dict[str, DataFrame], newest: int = 50) -> DataFrame:
    """Each record with its newest rows of each log as an array, newest first.

    A log has ``memory_id, created_at`` and more. The bound on rows shown is the feature.
    """
    out = records
    for name, log in logs.items():
        rest = [c for c in log.columns if c != "memory_id"]
        order = Window.partitionBy("memory_id").orderBy(F.desc("created_at"))
        top = log.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= newest)
        rows = top.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("_k", *rest))).alias(name))
        out = out.join(rows, "memory_id", "left")
    return out


def resolved_node(nodes: DataFrame, text: str) -> str | None:
    """The one node of that id, else path (symbols don't count), else label, in any case; None if there is none.

    Two nodes of the same tier are an error.
    """
    low = text.strip().lower()
    tier = (
        F.when(F.lower("id") == low, 1).when((F.col("type") != "symbol") & (F.lower("path") == low), 2).when(F.lower("label") == low, 3)
    )
    found = nodes.select("id", tier.alias("tier")).where("tier IS NOT NULL").orderBy("tier", "id").limit(2).collect()
    if len(found) == 2 and found[0]["tier"] == found[1]["tier"]:
        raise ValueError(f"{text!r} names more than one node")
    return found[0]["id"] if found else None


def memory_graph(records: DataFrame, relations: DataFrame, seeds: DataFrame, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Records within ``depth`` of the seeds, and the relations among them.

    ``records`` holds what the caller may see; a record that isn't there isn't walked through.
    Nodes come newest first by validity or update, at most ``limit`` of them; depth is at most 5.
    """
    edges = induced(records.select(F.col("memory_id").alias("id")), relations)
    near = reached(edges, seeds.select(F.col("memory_id").alias("id")), min(depth, MOST_HOPS))
    nodes = records.join(near.select(F.col("id").alias("memory_id"), "depth"), "memory_id")
    kept = nodes.orderBy(F.desc(F.coalesce("valid_from", "updated_at")), F.desc("updated_at"), F.asc("memory_id")).limit(limit)
    return kept, induced(kept.select(F.col("memory_id").alias("id")), edges)


def dirty_paths(*changed: DataFrame) -> DataFrame:
    """The distinct paths of several lists of changes, sorted, the first 200."""
    out = changed[0].select("path")
    for df in changed[1:]:
        out = out.union(df.select("path"))
    return out.distinct().orderBy("path").limit(MOST_DIRTY)


def overview_or_default(requests: DataFrame, overviews: DataFrame, as_of: str, seconds: int = 300, default: str = "No overview yet.") -> DataFrame:
    """``requests`` (tenant_id, project_id) with the summary kept for them, unless it has expired."""
    fresh = overviews.where(F.col("generated_at") + F.make_dt_interval(secs=F.lit(seconds)) >= F.lit(as_of).cast("timestamp_ntz"))
    best = fresh.groupBy("tenant_id", "project_id").agg(F.max_by("summary", "generated_at").alias("summary"))
    return requests.join(best, ["tenant_id", "project_id"], "left").fillna(default, ["summary"])


def purged(records: DataFrame, chunks: DataFrame, relations: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records, chunks and relations without those of removed files, and the ids that went."""
    gone = paths.select("path").distinct()
    ids = records.join(gone, "path", "left_semi").select("memory_id")
    left = relations.join(ids.withColumnRenamed("memory_id", "src"), "src", "left_anti").join(ids.withColumnRenamed("memory_id", "dst"), "dst", "left_anti")
    return records.join(gone, "path", "left_anti"), chunks.join(gone, "path", "left_anti"), left.select(*relations.columns), ids

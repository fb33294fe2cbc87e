"""Writes that check what they touch: guarded merges, selectors, logged feedback, nested records, onboarding, drift of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import upsert

#: Levels by which an erasure may be narrowed beside the tenant.
SELECTORS = ("workspace_id", "project_id", "user_id")


def guarded_upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str, tenant: str = "tenant_id") -> tuple[DataFrame, DataFrame]:
    """The table after a merge, and the changes that weren't taken: ``changes`` rows with ``reason``.

    A row's tenant never changes: a change of a key that another tenant owns is refused, and of
    a new key's changes those of another tenant than the first one's.
    """
    names = changes.columns
    owners = current.groupBy(*keys).agg(F.min(tenant).alias("_owner"))
    rows = changes.join(owners, keys, "left")
    first = F.first(tenant).over(Window.partitionBy(*keys).orderBy(order, tenant))
    rows = rows.withColumn("_owner", F.coalesce("_owner", first))
    foreign = F.coalesce(F.col("_owner") != F.col(tenant), F.lit(True))
    good = rows.where(~foreign).select(*names)
    return upsert(current, good, keys, order), rows.where(foreign).select(*names, F.lit("owned by another tenant").alias("reason"))


def erase_selector(tenant: str, **levels: str | None) -> Column:
    """Which records an erasure is about: a tenant's, narrowed by at least one level."""
    unknown = set(levels) - set(SELECTORS)
    given = {k: v for k, v in levels.items() if v}
    if unknown or not given or not tenant:
        raise ValueError(f"an erasure names a tenant and one or more of {', '.join(SELECTORS)}")
    ok = F.col("tenant_id") == tenant
    for name, value in given.items():
        ok = ok & (F.col(name) == value)
    return F.coalesce(ok, F.lit(False))


def nested_records(records: DataFrame, sources: DataFrame, triggers: DataFrame) -> DataFrame:
    """``records`` with the arrays ``source_references`` (in order of ``place``) and ``trigger_phrases`` (sorted, each once).

    ``sources`` has ``memory_id, place`` and more; ``triggers`` ``memory_id, phrase``. Each is
    gathered by record before it is joined.
    """
    rest = [c for c in sources.columns if c not in ("memory_id", "place")]
    gathered = sources.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("place", *rest))).alias("_s"))
    listed = gathered.select("memory_id", F.transform("_s", lambda s: F.struct(*[s[c].alias(c) for c in rest])).alias("source_references"))
    phrases = triggers.groupBy("memory_id").agg(F.array_sort(F.collect_set("phrase")).alias("trigger_phrases"))
    out = records.join(listed, "memory_id", "left").join(phrases, "memory_id", "left")
    kind = listed.schema["source_references"].dataType.simpleString()
    return out.withColumns({"source_references": F.coalesce("source_references", F.array().cast(kind)), "trigger_phrases": F.coalesce("trigger_phrases", F.array().cast("array<string>"))})


def onboarding(counts: DataFrame, cache_shared: bool = False) -> DataFrame:
    """``tenant_id, step, status, ready`` of each tenant, from counts of what it has.

    ``counts`` has ``tenant_id, connectors, sources, principals, grants, history``. A step is
    complete, pending, or a warning; a tenant is ready if all required ones are complete.
    """
    has = lambda c: F.col(c) > 0
    steps = (
        ("storage", F.lit(True), True), ("hot_cache", F.lit(cache_shared), False), ("connector_registry", has("connectors"), True), ("source_inventory", has("sources"), True),
        ("principal_mapping", has("principals"), True), ("source_permissions", has("grants"), True), ("memory_lifecycle", has("history"), False), ("benchmark_proof", F.lit(True), False),
    )
    each = [
        F.struct(F.lit(name).alias("step"), F.when(done, "complete").otherwise("warning" if name == "hot_cache" else "pending").alias("status"), (done | ~F.lit(required)).alias("fine"))
        for name, done, required in steps
    ]
    rows = counts.withColumn("_steps", F.array(*each))
    ready = F.forall("_steps", lambda s: s["fine"])
    return rows.select("tenant_id", ready.alias("ready"), F.explode("_steps").alias("s")).select("tenant_id", "s.step", "s.status", "ready")


def graph_statistics(nodes: DataFrame, ranks: DataFrame, degrees: DataFrame, most: int = 15) -> DataFrame:
    """``part, name, value``: nodes by type, and the ids that rank highest, ties by degree and id."""
    kinds = nodes.groupBy("type").agg(F.count("*").cast("double").alias("value")).select(F.lit("nodes").alias("part"), F.col("type").alias("name"), "value")
    joined = nodes.select("id").join(ranks, "id", "left").join(degrees.select("id", "centrality"), "id", "left").fillna(0.0, ["rank", "centrality"])
    best = joined.orderBy(F.desc("rank"), F.desc("centrality"), F.asc("id")).limit(most)
    return kinds.unionByName(best.select(F.lit("top").alias("part"), F.col("id").alias("name"), F.col("rank").alias("value")))


def ordered_fingerprint(rows: DataFrame, keys: list[str], place: str, line: str) -> DataFrame:
    """``keys, fingerprint``: the SHA-256 of lines in order, each with a newline.

    The bytes are hashed as one text, so a group must fit the 64 MiB that a ledger may have;
    larger ones are folded by ``strict_ledger.attestation``.
    """
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(line).alias("l")))).alias("_l"))
    text = F.concat(F.array_join(F.transform("_l", lambda x: x["l"]), "\n"), F.lit("\n"))
    return gathered.select(*keys, F.sha2(text, 256).alias("fingerprint"))


def feedback_added(records: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to append for feedback: ``feedback``, ``history`` and ``audit``.

    ``requests`` has ``feedback_id, memory_id, tenant_id, kind, comment, actor_id, at``; those on a
    record that isn't there, is deleted or is another tenant's are left out, and so is a
    repeated id. History holds the sums before and after as JSON, in the order of time.
    """
    live = records.where(F.col("status") != "deleted").select("memory_id", "tenant_id")
    once = F.row_number().over(Window.partitionBy("feedback_id").orderBy("at", "memory_id")) == 1
    good = requests.join(live, ["memory_id", "tenant_id"], "left_semi").withColumn("_once", once).where("_once").drop("_once")
    points = F.when(F.col("kind") == "positive", 1).when(F.col("kind") == "negative", -1).otherwise(0)
    upto = Window.partitionBy("memory_id").orderBy("at", "feedback_id").rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum(points).over(upto)
    state = lambda net: F.to_json(F.struct(F.col("memory_id"), net.cast("long").alias("net_score")))
    rows = good.withColumns({"_before": after - points, "_after": after})
    history = rows.select(
        "memory_id", "tenant_id", F.lit("feedback").alias("event"), state(F.col("_before")).alias("old_memory"), state(F.col("_after")).alias("new_memory"),
        F.to_json(F.struct("feedback_id", "kind")).alias("details"), "actor_id", F.col("at").alias("created_at"),
    )
    audit = rows.select(F.lit("memory.feedback").alias("action"), "memory_id", "tenant_id", F.to_json(F.struct("feedback_id", "kind")).alias("details"), F.col("at").alias("created_at"))
    return good, history, audit


def without_live_commands(found: DataFrame, commands: DataFrame, exact: DataFrame) -> DataFrame:
    """``found`` without memories of a command that the repository declares now, unless they were asked for.

    ``found`` has ``id, type, command, cwd``; ``commands`` ``command, cwd``; ``exact`` ``id``.
    """
    live = commands.select("command", "cwd").distinct().withColumn("_live", F.lit(True))
    asked = exact.select("id").distinct().withColumn("_asked", F.lit(True))
    rows = found.join(live, ["command", "cwd"], "left").join(asked, "id", "left")
    return rows.where(~((F.col("type") == "memory") & F.coalesce("_live", F.lit(False)) & F.col("_asked").isNull())).select(*found.columns)


def phrase_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``memory_id, tenant_id, wanted, found``: records whose indexed phrases aren't those they should have, in order of phrase.

    Both have ``memory_id, tenant_id, phrase``; a phrase of another tenant is one too many.
    """
    listed = lambda df, name: df.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("phrase", "tenant_id"))).alias(name))
    both = listed(expected, "wanted").join(listed(actual, "found"), "memory_id", "full_outer")
    return both.where(~F.col("wanted").eqNullSafe(F.col("found")))

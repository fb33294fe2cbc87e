"""The append-only ledger: heads, state as of a time, intervals, admission, lineage, reconciliation.

Events have ``id, created_at, status, authority`` and ``supersedes`` (an array of ids). Producer
time decides every view; nothing that arrives late is dropped.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which authority may supersede which, and the order of states.
AUTHORITY_RANK = {"tool": 1, "agent": 2, "system": 3, "human": 4}
STATUS_RANK = {"active": 0, "superseded": 1, "retracted": 2}


def rank(column: Column, ranks: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), column)


def references(events: DataFrame, *keep: str) -> DataFrame:
    """``id, target`` and more columns of the superseding event, for each event it supersedes."""
    return events.select("id", *keep, F.explode("supersedes").alias("target"))


def active_heads(events: DataFrame) -> DataFrame:
    """Active events that no event of the set supersedes."""
    gone = references(events).select(F.col("target").alias("id"))
    return events.where("status = 'active'").join(gone, "id", "left_anti")


def heads_as_of(events: DataFrame, as_of: str) -> DataFrame:
    """The heads among events made at or before a time."""
    return active_heads(events.where(F.col("created_at") <= F.lit(as_of).cast("timestamp_ntz")))


def intervals(events: DataFrame) -> DataFrame:
    """``id, valid_from, valid_to, n_predecessors, n_successors``.

    An event ends when its first successor begins; without one, an inactive event never held.
    """
    after = references(events, "created_at").groupBy("target").agg(F.min("created_at").alias("ends"), F.count("*").alias("n"))
    return events.join(after.withColumnRenamed("target", "id"), "id", "left").select(
        "id",
        F.col("created_at").alias("valid_from"),
        F.coalesce("ends", F.when(F.col("status") != "active", F.col("created_at"))).alias("valid_to"),
        F.size("supersedes").cast("long").alias("n_predecessors"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_successors"),
    )


def interval_violations(events: DataFrame) -> DataFrame:
    """``id, problem``: repeated ids, references to unknown ids, successors that begin earlier."""
    twice = events.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    linked = references(events, "created_at")
    known = events.select(F.col("id").alias("target"), F.col("created_at").alias("target_at"))
    unknown = linked.join(known, "target", "left_anti").select("id", F.lit("unknown reference").alias("problem"))
    early = linked.join(known, "target").where("created_at < target_at").select("id", F.lit("begins before what it supersedes").alias("problem"))
    return twice.unionByName(unknown).unionByName(early)


def admission(events: DataFrame) -> DataFrame:
    """``id, target`` and the first rule that a supersession breaks, null if it is admitted.

    No reference to itself or to an unknown event, no lower authority than the target's, no
    earlier time than the target's.
    """
    linked = references(events, "authority", "created_at")
    known = events.select(F.col("id").alias("target"), F.col("authority").alias("target_authority"), F.col("created_at").alias("target_at"))
    rule = (
        F.when(F.col("id") == F.col("target"), "self reference")
        .when(F.col("target_at").isNull(), "unknown reference")
        .when(rank(F.col("authority"), AUTHORITY_RANK) < rank(F.col("target_authority"), AUTHORITY_RANK), "lower authority")
        .when(F.col("created_at") < F.col("target_at"), "earlier than target")
    )
    return linked.join(known, "target", "left").select("id", "target", rule.alias("violation"))


def lineage(events: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, root, depth``: where the chain of supersessions of each event begins, and how far back.

    Pointers are doubled, so a chain of n events takes log2(n) joins. Where an event supersedes
    several, the smallest id is followed.
    """
    first = references(events).groupBy("id").agg(F.min("target").alias("up"))
    at = events.select("id").join(first, "id", "left").select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    for _ in range(rounds):
        above = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = at.join(above, "up", "left").select(
            "id", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")
        )
        step = saved(step)
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return at.select("id", F.coalesce("up", "id").alias("root"), "depth")


def lineage_errors(records: DataFrame) -> DataFrame:
    """``logical_key, id, problem`` of managed lineages; without an id where the whole lineage is at fault.

    ``records`` has ``logical_key, id, ledger_index, predecessor_id, action, supersedes,
    created_at, candidate, candidate_fingerprint``. Of a record the first problem is named, of
    a lineage each. A sound one is a chain: one root, one successor each, no cycle, no part that
    the root doesn't reach. Only lineages with a pointer to a later record can have cycles;
    those are followed by doubling, so a chain of n records takes log2(n) joins.
    """
    seen = F.struct("ledger_index", "created_at", "action", "candidate", "candidate_fingerprint")
    prior = records.select("logical_key", F.col("id").alias("predecessor_id"), seen.alias("_p"))
    linked = saved(records.join(prior, ["logical_key", "predecessor_id"], "left"))
    root = F.col("predecessor_id").isNull()
    problem = (
        F.when(root & ((F.col("action") != "ADD") | (F.size("supersedes") != 0)), "root-action")
        .when(root, None)
        .when(F.col("action") == "ADD", "successor-action")
        .when(F.col("_p").isNull() | (F.col("_p.ledger_index") >= F.col("ledger_index")), "orphan-predecessor")
        .when((F.size("supersedes") != 1) | ~F.try_element_at("supersedes", F.lit(1)).eqNullSafe(F.col("predecessor_id")) | (F.col("created_at") < F.col("_p.created_at")), "predecessor-contract")
        .when((F.col("action") == "RETRACT") & ((F.col("_p.action") == "RETRACT") | ~F.col("candidate").eqNullSafe(F.col("_p.candidate"))), "retraction-contract")
        .when((F.col("action") == "SUPERSEDE") & (F.col("_p.action") != "RETRACT") & F.col("candidate_fingerprint").eqNullSafe(F.col("_p.candidate_fingerprint")), "redundant-successor")
    )
    own = linked.select("logical_key", "id", problem.alias("problem")).where("problem IS NOT NULL")

    children = linked.where(~root).groupBy("logical_key", "predecessor_id").agg(F.count("*").alias("n")).groupBy("logical_key").agg(F.max("n").alias("forks"))
    roots = linked.groupBy("logical_key").agg(F.count_if(root).alias("roots"), F.max(F.col("_p.ledger_index") >= F.col("ledger_index")).alias("turns"), F.count("*").alias("size"))
    shape = saved(roots.join(children, "logical_key", "left"))
    none = F.lit(None).cast(records.schema["id"].dataType).alias("id")
    heads = shape.where("roots <> 1 OR forks > 1").select("logical_key", none, F.lit("multiple-heads").alias("problem"))

    at = linked.join(shape.where("turns").select("logical_key"), "logical_key", "left_semi")
    at = saved(at.select("logical_key", "id", F.when(F.col("_p").isNotNull(), F.col("predecessor_id")).alias("up")))
    longest = shape.where("turns").agg(F.max("size")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        above = at.select("logical_key", F.col("id").alias("up"), F.col("up").alias("next"))
        at = saved(at.join(above, ["logical_key", "up"], "left").select("logical_key", "id", F.col("next").alias("up")))
    lost = at.where("up IS NOT NULL")  # after more steps than there are records: these never end
    turning = lost.select("logical_key", F.col("up").alias("id")).distinct()
    cycles = turning.withColumn("problem", F.lit("supersession-cycle"))
    apart = lost.select("logical_key", "id").join(turning, ["logical_key", "id"], "left_anti").withColumn("problem", F.lit("disconnected-lineage"))
    return own.unionByName(heads).unionByName(cycles).unionByName(apart)


def lineage_guards(events: DataFrame, managed: DataFrame) -> DataFrame:
    """``logical_key, tool_descendant, higher_descendant``: managed lineages that an unmanaged head builds on.

    ``managed`` has ``id, logical_key``. Heads are events that nothing supersedes; from those
    that aren't managed the references are followed down to the first managed event of each
    path. A tool's descendant is an error, one of other authority protects the lineage. Runs of
    unmanaged events with one reference each are passed at once, by doubling, so a chain of n
    takes log2(n) joins.
    """
    pointers = saved(references(events).distinct())
    heads = events.join(pointers.select(F.col("target").alias("id")), "id", "left_anti").join(managed, "id", "left_anti")
    pointers = _past_runs(pointers, managed)
    at = saved(heads.select("id", (F.col("authority") == "tool").alias("tool")).join(pointers, "id").select(F.col("target").alias("id"), "tool").distinct())
    seen, found = at, None
    while not at.isEmpty():
        hit = at.join(managed, "id").select("logical_key", "tool")
        found = hit if found is None else found.unionByName(hit)
        below = at.join(managed, "id", "left_anti").join(pointers, "id").select(F.col("target").alias("id"), "tool").distinct()
        at = saved(below.join(seen, ["id", "tool"], "left_anti"))
        seen = seen.unionByName(at)
    if found is None:
        found = managed.limit(0).select("logical_key", F.lit(True).alias("tool"))
    return found.groupBy("logical_key").agg(F.max("tool").alias("tool_descendant"), F.max(~F.col("tool")).alias("higher_descendant"))


def _past_runs(pointers: DataFrame, managed: DataFrame) -> DataFrame:
    """``id, target`` where a target that is unmanaged and has one reference is replaced by where its run ends.

    Runs that turn in a circle end nowhere and are left out.
    """
    single = pointers.join(managed.select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n"), F.min("target").alias("up")).where("n = 1")
    at = saved(single.select("id", "up", F.lit(True).alias("moved")))
    for _ in range(int(at.count()).bit_length() + 1):
        above = at.select(F.col("id").alias("up"), F.col("up").alias("next"))
        at = saved(at.join(above, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
    ends = at.select(F.col("id").alias("target"), F.when(~F.col("moved"), F.col("up")).alias("up"), F.lit(True).alias("run"))
    passed = pointers.join(ends, "target", "left").select("id", F.when(F.col("run"), F.col("up")).otherwise(F.col("target")).alias("target"))
    return saved(passed.where("target IS NOT NULL").distinct())


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the session names.

    Where none is named, a local run gets a folder of its own and a cluster an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="memloom-"))
    return df.checkpoint()


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows, so that a few large groups aren't joined in a task each."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, size: Column | None = None) -> DataFrame:
    """``df`` with ``name``, the place of each row in its group by ``order``, from 1; with ``size`` also ``name_total``, its sum so far.

    A group may hold nearly all rows: they are sorted over all tasks by ranges, counted within
    each range, and go on from what the ranges before have of their group. ``order`` is total.
    """
    made = df if size is None else df.withColumn("_size", size)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, so that small rows aren't put into few tasks
    at = made.repartitionByRange(ranges, *group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id())
    at = saved(at.withColumn("_part", F.shiftright("_at", 33)))
    total = F.sum("_size") if size is not None else F.lit(0)
    runs = at.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), total.cast("long").alias("_bytes"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    runs = runs.select(
        *[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_run"), (so_far("_n") - F.col("_first") + 1).alias("_shift"), so_far("_bytes").alias("_held")
    )
    if size is not None:
        at = at.withColumn(f"{name}_total", F.sum("_size").over(Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("_part") == F.col("_run")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = at.join(small(saved(runs)), same).withColumn(name, F.col("_at") + F.col("_shift"))
    if size is not None:
        out = out.withColumn(f"{name}_total", F.col(f"{name}_total") + F.col("_held"))
    return out.drop("_at", "_part", "_size", "_run", "_shift", "_held", *[f"_{g}" for g in group])


def reconcile(old: DataFrame, new: DataFrame, scan_complete: bool = True) -> DataFrame:
    """``logical_key, action``: what turns the heads of a lineage into the candidates.

    ``old`` has ``logical_key, fingerprint, authority, status``; ``new`` has ``logical_key,
    fingerprint``. A head of human authority isn't replaced but left in conflict; a head is
    retracted only after a complete scan, else the decision is deferred.
    """
    both = old.select("logical_key", F.col("fingerprint").alias("was"), "authority").join(
        new.select("logical_key", F.col("fingerprint").alias("now")), "logical_key", "full_outer"
    )
    action = (
        F.when(F.col("was").isNull(), "ADD")
        .when(F.col("now").isNull(), "RETRACT" if scan_complete else "DEFER")
        .when(F.col("was") == F.col("now"), "NOOP")
        .when(F.col("authority") == "human", "CONFLICT")
        .otherwise("SUPERSEDE")
    )
    return both.select("logical_key", action.alias("action"))


def index_diff(state: DataFrame, found: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """``key, change``: added, changed, removed or unchanged, by content hash."""
    both = state.select(key, F.col(value).alias("was")).join(found.select(key, F.col(value).alias("now")), key, "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    )
    return both.select(key, change.alias("change"))


def suppressed(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``events`` with ``suppressed``: an erased event must not come back by a replay."""
    marks = tombstones.select("id", F.lit(True).alias("erased")).distinct()
    return events.join(marks, "id", "left").withColumn("suppressed", F.coalesce("erased", F.lit(False))).drop("erased")


def merged_status(current: Column, incoming: Column) -> Column:
    """The later of two states: active, then superseded, then retracted."""
    first = F.coalesce(rank(current, STATUS_RANK), F.lit(0))
    return F.when(F.coalesce(rank(incoming, STATUS_RANK), F.lit(0)) > first, incoming).otherwise(current)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after a merge: of each key the row with the latest ``order``, changes winning ties.

    Both have the same columns. The newest row is found by an aggregate, not a window, so a key
    with very many versions is combined before the shuffle.
    """
    rest = [c for c in current.columns if c not in keys]
    tagged = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    best = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(*current.columns)


def projected(current: DataFrame, rows: DataFrame, projection: str) -> DataFrame:
    """A store of several projections after one of them was written anew.

    Both have ``projection, kind, id, payload``. Rows of the projection that aren't written any
    more go, those of other projections stay, and a row written twice counts once, the greater
    payload of both.
    """
    new = rows.withColumn("projection", F.lit(projection)).groupBy("projection", "kind", "id").agg(F.max("payload").alias("payload"))
    others = current.where(F.col("projection") != projection)
    return others.select("projection", "kind", "id", "payload").unionByName(new)


def partition_errors(supplied: DataFrame, kept: DataFrame, omitted: DataFrame, key: str = "id") -> DataFrame:
    """``key, problem``: where kept and omitted rows aren't exactly the supplied ones, each once."""
    tagged = supplied.select(key, F.lit(1).alias("s"), F.lit(0).alias("k"), F.lit(0).alias("o"))
    tagged = tagged.union(kept.select(key, F.lit(0), F.lit(1), F.lit(0))).union(omitted.select(key, F.lit(0), F.lit(0), F.lit(1)))
    seen = tagged.groupBy(key).agg(F.sum("s").alias("s"), F.sum("k").alias("k"), F.sum("o").alias("o"))
    problem = (
        F.when(F.col("s") == 0, "not supplied").when((F.col("k") > 0) & (F.col("o") > 0), "kept and omitted").when(F.col("k") + F.col("o") == 0, "lost")
        .when(F.col("k") + F.col("o") != F.col("s"), "repeated")
    )
    return seen.select(key, problem.alias("problem")).where("problem IS NOT NULL")

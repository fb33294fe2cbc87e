"""Record lifecycle: dedupe on create, updates, deletes, holds, retention, erasure.

Tables are immutable here: each operation returns the new version of the table or the rows it
would touch. There is no isolation between several writers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Hold:
    """A legal hold on listed ids or on a scope; an empty scope matches nothing."""

    reason: str
    ids: Sequence[int] = ()
    scope: dict[str, str] = field(default_factory=dict)
    until: str | None = None


@dataclass(frozen=True)
class Policy:
    """Records of a kind (or of all) older than so many days at ``as_of`` are due."""

    policy_id: str
    max_age_days: int
    kind: str | None = None
    action: str = "soft"


def record_fingerprint(scope: Column, kind: Column, title: Column, content: Column) -> Column:
    return T.fingerprint(scope, kind, F.lower(F.trim(title)), F.lower(F.trim(content)))


def created(existing: DataFrame, incoming: DataFrame, order: Sequence[str] = ("created_at", "memory_id")) -> DataFrame:
    """Of ``incoming`` what is new: the first of each fingerprint that no existing record has.

    A deleted record's fingerprint is a tombstone and blocks too.
    """
    rest = [c for c in incoming.columns if c != "fingerprint"]
    first = incoming.groupBy("fingerprint").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return (
        first.join(existing.select("fingerprint").distinct(), "fingerprint", "left_anti")
        .select("fingerprint", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*incoming.columns)
    )


def patched(current: DataFrame, changes: DataFrame, key: str = "memory_id") -> DataFrame:
    """``current`` with the fields named in each change's ``set`` array replaced, null included."""
    fields = [c for c in changes.columns if c not in (key, "set")]
    new = changes.select(key, "set", *[F.col(c).alias(f"_{c}") for c in fields])
    joined = current.join(new, key, "left")
    value = lambda c: F.when(F.array_contains("set", c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
    return joined.select(*[value(c) for c in current.columns])


def hold_states(records: DataFrame, holds: Sequence[Hold], as_of: str, key: str = "memory_id") -> DataFrame:
    """``key, reasons, hold_until`` of the records that an active hold covers.

    Reasons are distinct, sorted and joined by semicolons. One hold without an end leaves the
    record without one; else the latest end counts.
    """
    reasons, ends, open_ended = [], [], F.lit(False)
    for h in holds:
        if h.until is not None and h.until <= as_of:
            continue
        match = F.col(key).isin(*h.ids) if h.ids else F.lit(False)
        if h.scope:
            scope = F.lit(True)
            for c, v in h.scope.items():
                scope = scope & F.coalesce(F.col(c) == v, F.lit(False))
            match = match | scope
        reasons.append(F.when(match, h.reason))
        if h.until is None:
            open_ended = open_ended | match
        else:
            ends.append(F.when(match, h.until))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))
    end = F.array_max(F.array_compact(F.array(*ends))) if ends else F.lit(None).cast("string")
    return (
        records.select(key, found.alias("r"), F.when(~open_ended, end).alias("hold_until"))
        .where(F.size("r") > 0).select(key, F.array_join("r", "; ").alias("reasons"), "hold_until")
    )


def due_for_retention(records: DataFrame, policies: Sequence[Policy], as_of: str, created_at: str, kind: str) -> DataFrame:
    """Records with the first policy under which they are due, once each, deleted ones left out.

    Policies are a short list and become one expression over the scan, so nothing is joined.
    """
    now, which = F.lit(as_of).cast("timestamp_ntz"), None
    for p in policies:
        due = F.col(created_at).cast("timestamp_ntz") < now - F.make_dt_interval(F.lit(p.max_age_days))
        if p.kind is not None:
            due = due & (F.col(kind) == p.kind)
        which = F.when(due, p.policy_id) if which is None else which.when(due, p.policy_id)
    rows = records.where(F.col("status") != "deleted") if "status" in records.columns else records
    return rows.withColumn("policy_id", which if which is not None else F.lit(None).cast("string")).where("policy_id IS NOT NULL")


def deleted(records: DataFrame, ids: DataFrame, held: DataFrame, hard: bool = False, key: str = "memory_id") -> DataFrame:
    """The table after a delete. A held row isn't removed; softly deleted, it waits as held."""
    marks = ids.select(key, F.lit(True).alias("_gone")).distinct()
    kept = held.select(key, F.lit(True).alias("_held")).distinct()
    rows = records.join(marks, key, "left").join(kept, key, "left")
    if hard:
        return rows.where("_gone IS NULL OR _held IS NOT NULL").select(*records.columns)
    new = F.when(F.col("_gone").isNotNull() & F.col("_held").isNull(), "deleted").otherwise(F.col("status"))
    before = F.when(F.col("_gone").isNotNull() & F.col("_held").isNotNull(), "deleted")
    out = rows.withColumns({"status": new, "pre_hold_status": before})
    return out.select(*[c for c in records.columns if c != "pre_hold_status"], "pre_hold_status")


def erasure(records: DataFrame, children: dict[str, DataFrame], held: DataFrame, key: str = "memory_id") -> DataFrame:
    """One row: ``n_erased, n_held`` and, for each child table, how many of its rows go along."""
    gone = records.select(key).join(held.select(key).distinct(), key, "left_anti")
    out = gone.agg(F.count("*").alias("n_erased")).select(F.lit("n_erased").alias("what"), F.col("n_erased").alias("n"))
    out = out.unionByName(records.join(held.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n")).select(F.lit("n_held").alias("what"), "n"))
    for name, child in children.items():
        hit = child.join(gone.distinct(), key, "left_semi").agg(F.count("*").alias("n"))
        out = out.unionByName(hit.select(F.lit(f"n_{name}").alias("what"), "n"))
    return out


def forgotten(records: DataFrame, tables: dict[str, DataFrame], holds: Sequence[Hold], as_of: str, owner: str, owners: DataFrame, key: str = "memory_id") -> dict[str, DataFrame]:
    """What is left after all records of some owners were erased: ``records``, each table, and what was done.

    ``owners`` has the column ``owner``. Records that a hold covers stay, with what belongs to
    them. Tables are those with rows of records (``key``) or of relations (``src, dst``), which
    go with either end. ``erased`` has the key and owner of what went, ``kept`` the key, owner
    and reasons of what a hold kept; ``events`` are audit rows, one an owner, also where nothing
    was erased. Running it again changes nothing.
    """
    asked = owners.select(owner).distinct()
    theirs = records.join(asked, owner, "left_semi")
    held = hold_states(theirs, holds, as_of, key)
    gone = theirs.join(held.select(key), key, "left_anti").select(key, owner)
    ids = gone.select(key).distinct()
    out = {"records": records.join(ids, key, "left_anti").select(*records.columns)}
    for name, df in tables.items():
        ends = [key] if key in df.columns else ["src", "dst"]
        left = df
        for end in ends:
            left = left.join(ids.withColumnRenamed(key, end), end, "left_anti")
        out[name] = left.select(*df.columns)
    out["erased"] = gone
    out["kept"] = theirs.select(key, owner).join(held.select(key, "reasons"), key)
    counts = gone.groupBy(owner).agg(F.count("*").alias("n_erased"))
    waits = out["kept"].groupBy(owner).agg(F.count("*").alias("n_held"))
    events = asked.join(counts, owner, "left").join(waits, owner, "left").fillna(0, ["n_erased", "n_held"])
    out["events"] = events.select(owner, F.lit("right_to_be_forgotten").alias("action"), F.lit(as_of).alias("at"), "n_erased", "n_held")
    return out

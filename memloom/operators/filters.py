"""Which records a request can see: scope, status, kind, tags, validity, with all reasons against."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE_LEVELS = ("workspace_id", "project_id", "user_id", "agent_id", "session_id")


@dataclass(frozen=True)
class Request:
    """A search request; empty selectors don't filter. ``as_of`` stands for now."""

    tenant_id: str
    scope: dict[str, str] = field(default_factory=dict)
    kinds: Sequence[str] = ()
    layers: Sequence[str] = ()
    tags: Sequence[str] = ()
    entity_keys: Sequence[str] = ()
    include_deleted: bool = False
    as_of: str = "2024-02-01 00:00:00"
    limit: int = 10


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def in_scope(df: DataFrame, request: Request) -> Column:
    """Same tenant, and no level that both sides set and set differently."""
    ok = F.col("tenant_id") == request.tenant_id
    for level in SCOPE_LEVELS:
        if level in request.scope and _has(df, level):
            ok = ok & (F.col(level).isNull() | (F.col(level) == request.scope[level]))
    return ok


def live(df: DataFrame, include_deleted: bool = False) -> Column:
    """Neither deleted nor retracted; superseded only if it projects the ledger."""
    if include_deleted or not _has(df, "status"):
        return F.lit(True)
    ok = ~F.col("status").isin("deleted", "retracted")
    if _has(df, "ledger_projection"):
        ok = ok & ~((F.col("status") == "superseded") & F.col("ledger_projection"))
    return ok


def valid_at(as_of: Column, valid_from: Column, valid_to: Column, expires_at: Column) -> Column:
    """Begun, not past an inclusive end, not at or past an exclusive expiry; nulls don't bound."""
    return (
        F.coalesce(as_of >= valid_from, F.lit(True))
        & F.coalesce(as_of <= valid_to, F.lit(True))
        & F.coalesce(expires_at > as_of, F.lit(True))
    )


def has_all_tags(tags: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0 if wanted else F.lit(True)


def has_any_entity(keys: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(True)


def under_path(path: Column, prefix: str) -> Column:
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def rejection_reasons(df: DataFrame, request: Request, denied: Column | None = None) -> Column:
    """All reasons against a record, in a fixed order; none if it is accepted."""
    as_of, reasons = F.lit(request.as_of).cast("timestamp_ntz"), []
    if denied is not None:
        reasons.append(F.when(denied, "acl denied"))
    reasons.append(F.when(~F.coalesce(in_scope(df, request), F.lit(False)), "scope mismatch"))
    if request.kinds:
        reasons.append(F.when(~F.col("kind").isin(*request.kinds), "kind filtered"))
    if request.layers:
        reasons.append(F.when(~F.col("memory_layer").isin(*request.layers), "memory layer filtered"))
    if request.tags:
        missing = F.array_sort(F.array_except(F.array(*map(F.lit, request.tags)), F.col("tags")))
        reasons.append(F.when(F.size(missing) > 0, F.concat(F.lit("missing tags: "), F.array_join(missing, ", "))))
    if request.entity_keys:
        reasons.append(F.when(~has_any_entity(F.col("entity_keys"), request.entity_keys), "entity keys filtered"))
    if not request.include_deleted and _has(df, "status"):
        reasons.append(F.when(~live(df), F.col("status")))
    if _has(df, "valid_from"):
        reasons.append(F.when(as_of < F.col("valid_from"), "not yet valid"))
    if _has(df, "valid_to"):
        reasons.append(F.when(as_of > F.col("valid_to"), "validity ended"))
    if _has(df, "expires_at"):
        reasons.append(F.when(F.col("expires_at") <= as_of, "expired"))
    return F.array_compact(F.array(*reasons))

"""Row-level access: entries of a record's list, and grants on all of its connected sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The levels of a grant that allow each use, and the roles that may write.
LEVELS = {
    "read": ("view", "comment", "edit", "owner"),
    "comment": ("comment", "edit", "owner"),
    "edit": ("edit", "owner"),
    "owner": ("owner",),
}
WRITE_ROLES = ("editor", "admin", "superadmin")
#: What each role may do.
ROLE_PERMISSIONS = {
    "viewer": ("read",),
    "editor": ("read", "write"),
    "admin": ("read", "write", "delete", "admin"),
    "superadmin": ("read", "write", "delete", "admin"),
}


@dataclass(frozen=True)
class Caller:
    principal_id: str | None = None
    tenant_id: str | None = None
    role: str = "viewer"
    groups: Sequence[str] = ()
    bound_scope: dict[str, str] = field(default_factory=dict)


def can_access(caller: Caller, required: str = "read") -> Column:
    """Over ``tenant_id`` and ``acl`` (structs of principal_id, principal_type, permissions).

    Bound scope binds every role; then superadmins pass, other tenants don't, admins pass, and
    an empty list opens a record to its tenant. Otherwise an entry for the principal or one of
    its groups must hold the permission or ``admin``.
    """
    bound = F.lit(True)
    for level, value in caller.bound_scope.items():
        bound = bound & F.coalesce(F.col(level) == value, F.lit(False))
    if caller.role == "superadmin":
        return bound
    tenant = F.lit(True) if caller.tenant_id is None else F.coalesce(F.col("tenant_id") == caller.tenant_id, F.lit(False))
    if caller.role == "admin":
        return bound & tenant
    names = [*([caller.principal_id] if caller.principal_id else []), *(f"group:{g}" for g in caller.groups)]

    def grants(entry: Column) -> Column:
        name = F.when(
            (entry["principal_type"] == "group") & ~entry["principal_id"].startswith("group:"),
            F.concat(F.lit("group:"), entry["principal_id"]),
        ).otherwise(entry["principal_id"])
        may = F.array_contains(entry["permissions"], required) | F.array_contains(entry["permissions"], "admin")
        return name.isin(*names) & may if names else F.lit(False)

    empty = F.coalesce(F.size("acl"), F.lit(0)) <= 0
    return bound & tenant & (empty | F.coalesce(F.exists("acl", grants), F.lit(False)))


def source_grants(sources: DataFrame, grants: DataFrame, principals: Sequence[str], use: str = "read") -> DataFrame:
    """``memory_id, n_sources, n_granted, allowed``: a grant is needed on every connected source.

    ``sources`` has ``memory_id, source_id``; ``grants`` has ``source_id, principal_id,
    permission_level``. Grants are brought down to one row a source before the join.
    """
    own = (
        grants.where(F.col("principal_id").isin(*principals) & F.col("permission_level").isin(*LEVELS[use]))
        .select("source_id").distinct().withColumn("granted", F.lit(1))
    )
    return (
        sources.select("memory_id", "source_id").distinct()
        .join(own, "source_id", "left")
        .groupBy("memory_id")
        .agg(F.count("*").alias("n_sources"), F.count("granted").alias("n_granted"))
        .withColumn("allowed", F.col("n_sources") == F.col("n_granted"))
    )


def expanded_principals(mappings: DataFrame) -> DataFrame:
    """``connector_id, local_principal_id, principals``: an identity, its remote ids and groups, per connector."""
    names = F.concat(
        F.array("local_principal_id", "remote_principal_id"), F.coalesce("groups", F.array().cast("array<string>"))
    )
    return (
        mappings.select("connector_id", "local_principal_id", F.explode(names).alias("name"))
        .groupBy("connector_id", "local_principal_id")
        .agg(F.array_sort(F.collect_set("name")).alias("principals"))
    )


def role_permissions(users: DataFrame) -> DataFrame:
    """``users`` (with ``role``) and the permissions of the role; none for an unknown one."""
    known = F.create_map(*[x for r, p in ROLE_PERMISSIONS.items() for x in (F.lit(r), F.array(*map(F.lit, p)))])
    return users.withColumn("permissions", F.coalesce(F.element_at(known, F.col("role")), F.array().cast("array<string>")))

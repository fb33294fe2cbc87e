"""Counts and states that tell how a store is doing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_counts(df: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """All counts of a table in one pass."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def freshness_deadline(stale_after: Column, last_synced: Column, sla_seconds: Column) -> Column:
    """The stated deadline, else the last sync plus a positive allowance, else none."""
    return F.coalesce(stale_after, F.when(sla_seconds > 0, last_synced + F.make_dt_interval(secs=sla_seconds)))


def orphans(child: DataFrame, child_keys: list[str], parent: DataFrame, parent_keys: list[str], name: str) -> DataFrame:
    """``name, n``: rows of a child table whose parent isn't there."""
    on = [F.col(c) == F.col(p) for c, p in zip(child_keys, parent_keys, strict=True)]
    return child.join(parent.select(*parent_keys).distinct(), on, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def ancestors(path: Column) -> Column:
    """The directories above a path, the nearest last; "." for the root."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts) - 1
    deeper = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(F.array(F.lit(".")), deeper)


def directory_counts(files: DataFrame) -> DataFrame:
    """``directory, file_count`` with the files of all directories below."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("directory")).groupBy("directory").agg(F.count("*").alias("file_count"))


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts up to each bound, with the count and sum of all."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{b:g}") for b in bounds]
    return df.groupBy(*keys).agg(*buckets, F.count(value).alias("n"), F.sum(value).alias("total"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, exact."""
    return df.groupBy(*keys).agg(*[F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, s in shares.items()])


def production_evidence(connectors: Column, records: Column, grants: Column) -> Column:
    """How far a tenant has come, by thresholds on what it has connected."""
    return (
        F.when((connectors >= 3) & (records >= 1000) & (grants >= 100), "enterprise_candidate")
        .when((connectors >= 1) & (records >= 50), "pilot").otherwise("demo")
    )


def skip_reason(status: Column, enabled: Column, cadence: Column, job_status: Column, last_finished: Column, as_of: Column, has_worker: Column) -> Column:
    """Why a scheduled connector isn't run at ``as_of``; null if it is."""
    return (
        F.when(status != "active", "inactive").when(~enabled, "disabled").when(cadence.isNull(), "missing cadence")
        .when(job_status == "running", "in-progress")
        .when(last_finished + F.make_dt_interval(secs=cadence) > as_of, "not-due")
        .when(~has_worker, "provider_not_implemented")
    )

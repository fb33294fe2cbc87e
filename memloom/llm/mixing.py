"""Mix sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rates above this are split into equal parts that are drawn apart; exp(-rate) stays exact.
PART = 300.0
#: Up to so many sources (a row of a few hundred bytes each) are broadcast; more are joined.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... to far beyond the mean."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(at: Column, k: Column) -> Column:
        p = at["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(at["c"], F.array(F.element_at(at["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda at: at["c"])


def rates(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, size: int | None = None
) -> DataFrame:
    """``source, rate, parts, cdf``: how often a document of each source is to be repeated.

    The rate is the source's target weight times ``size`` (default: as many rows as ``docs``
    has), over its number of documents. Without ``weights`` a source of n documents weighs
    n to the power 1/temperature; with them, a source that they don't name gets none.
    """
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        power = F.sqrt("n") if temperature == 2.0 else F.pow("n", F.lit(1 / temperature))
        weighed = counts.withColumn("w", power)
    else:
        named = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "source string, w double"
        )
        weighed = counts.join(named, "source", "left").fillna(0.0, ["w"])
    total = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    rows, whole = float(size if size is not None else total["n"] or 0), float(total["w"] or 0) or 1.0
    rate = F.col("w") / F.lit(whole) * F.lit(rows) / F.col("n")
    part = F.greatest(F.ceil(F.col("rate") / PART).cast("int"), F.lit(1))
    return (
        weighed.select("source", rate.alias("rate"))
        .withColumn("parts", part)
        .withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))
    )


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 2.0,
    size: int | None = None,
    seed: str = "mix-1",
) -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, in a shuffled order.

    ``docs`` needs ``doc_id`` and ``source``; all its columns are returned, with ``copy`` (from
    1) and ``shuffle_key`` (a long; rows are dealt to partitions by it and sorted by it inside
    each). Columns of these two names are replaced. The number of copies is the Poisson
    inverse at a uniform number hashed from ``seed`` and ``doc_id``, so it is the same in every
    run and rows with equal ids get equally many copies. Null is a source of its own, and a
    null id is hashed as the empty text. An empty table gives an empty one.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("copy", "shuffle_key")]
    table = rates(docs, weights, temperature, size).select(
        F.col("source").alias("_source"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf")
    )
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def drawn(part: Column) -> Column:
        u = uniform(seed, key, part)
        return F.size(F.filter(F.col("_cdf"), lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda n, part: n + drawn(part))
    at = F.xxhash64(F.lit(seed), key, F.col("copy"))
    return (
        docs.select(*kept)
        .join(table, F.col("source").cast("string").eqNullSafe(F.col("_source")))
        .withColumn("_copies", copies)
        .where("_copies > 0")
        .select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long"))).alias("copy"))
        .withColumn("shuffle_key", at)
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key", "doc_id", "copy")
    )

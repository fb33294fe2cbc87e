"""Hybrid retrieval: keyword rank, vector neighbours, fusion, record score, reranking, abstention."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from .filters import Request
from .ledger import saved

# Task functions travel with the job, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1, B = 1.2, 0.75
FULL_TEXT_WEIGHT, VECTOR_WEIGHT = 0.55, 0.45
ABSTAIN_BELOW = 0.15


def top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows of a total order; Spark keeps ``limit`` rows a task."""
    return df.orderBy(*order).limit(limit)


def bm25(records: DataFrame, query: str, keep: Sequence[str] = ("memory_id",)) -> DataFrame:
    """``keep`` and ``bm25`` of the records that have a query term.

    Term counts are taken from the row's own words, so no posting list is shuffled; the corpus
    statistics are one row of sums, brought to the driver.
    """
    terms = T.query_terms(query)
    counted = records.select(*keep, T.words(F.col("content")).alias("_w")).select(
        *keep,
        F.size("_w").alias("_len"),
        *[F.size(F.filter("_w", F.lit(t).eqNullSafe)).alias(f"_tf{i}") for i, t in enumerate(terms)],
    )
    totals = counted.agg(
        F.count("*").alias("n"),
        F.avg("_len").alias("mean"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    ).first()
    n, mean, score, found = totals["n"], totals["mean"] or 1.0, F.lit(0.0), F.lit(False)
    for i in range(len(terms)):
        df, tf = totals[f"df{i}"], F.col(f"_tf{i}")
        idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_len") / F.lit(mean)))
        found = found | (tf > 0)
    return counted.where(found).select(*keep, score.alias("bm25"))


def neighbours(vectors: DataFrame, query: Sequence[float], keep: Sequence[str], column: str = "embedding") -> DataFrame:
    """``keep`` and ``similarity`` of the vectors of the query's length with a positive cosine."""
    sized = vectors.where(F.size(column) == len(query))
    return sized.select(*keep, V.cosine(F.col(column), V.literal(query)).alias("similarity")).where("similarity > 0")


def keyword_score(rank: Column) -> Column:
    return F.abs(rank) / (1 + F.abs(rank))


def fused(fts: Column, vec: Column) -> Column:
    return (
        F.when((fts > 0) & (vec > 0), FULL_TEXT_WEIGHT * fts + VECTOR_WEIGHT * vec).when(vec > 0, vec).otherwise(fts)
    )


def merge_candidates(fts: DataFrame, vec: DataFrame, key: str = "memory_id") -> DataFrame:
    """``key, fts, vec, score, strategy`` of the keyed union of both candidate lists."""
    both = fts.join(vec, key, "full_outer").select(
        key, F.coalesce("fts", F.lit(0.0)).alias("fts"), F.coalesce("vec", F.lit(0.0)).alias("vec")
    )
    label = (
        F.when((F.col("fts") > 0) & (F.col("vec") > 0), "hybrid").when(F.col("vec") > 0, "vector").otherwise("fts")
    )
    return both.select(key, "fts", "vec", fused(F.col("fts"), F.col("vec")).alias("score"), label.alias("strategy"))


def recency_bonus(as_of: Column, updated_at: Column) -> Column:
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(updated_at.cast("timestamp"))) / F.lit(86_400_000_000)
    return F.when(age <= 1, 0.3).when(age <= 7, 0.15).when(age <= 30, 0.05).otherwise(0.0)


def feedback_net(positive: Column, negative: Column, correction: Column, pin: Column) -> Column:
    return F.round(
        F.least(positive * 0.12, F.lit(0.6)) - F.least(negative * 0.15, F.lit(0.6))
        + F.least(correction * 0.05, F.lit(0.25)) + F.least(pin * 0.4, F.lit(0.8)),
        4,
    )


def inferred_layer(session_id: Column, agent_id: Column, user_id: Column) -> Column:
    return (
        F.when(session_id.isNotNull(), "session").when(agent_id.isNotNull() & user_id.isNull(), "agent")
        .when(user_id.isNotNull(), "user").otherwise("organization")
    )


def layer_bonus(df: DataFrame, request: Request) -> tuple[Column, Column]:
    """Bonus and its reason; two missing ids of a level count as the same one."""
    same = lambda level: (
        F.col(level).eqNullSafe(F.lit(request.scope.get(level))) if level in df.columns else F.lit(request.scope.get(level) is None)
    )
    layer = F.col("memory_layer") if "memory_layer" in df.columns else F.lit("organization")
    rules = (
        ("conversation", same("session_id"), 1.1), ("session", same("session_id"), 0.9), ("user", same("user_id"), 0.7),
        ("agent", same("agent_id"), 0.55), ("organization", F.lit(True), 0.35),
    )
    bonus, reason = None, None
    for name, ok, value in rules:
        hit = (layer == name) & ok
        bonus = F.when(hit, value) if bonus is None else bonus.when(hit, value)
        reason = F.when(hit, f"{name} layer") if reason is None else reason.when(hit, f"{name} layer")
    return bonus.otherwise(0.0), reason


def scored(df: DataFrame, request: Request, query: str, retrieval: Column | None = None) -> DataFrame:
    """``df`` with ``score`` and ``reasons``; records that match nothing score 0 without reasons.

    Uses ``title, content, tags, entity_keys, importance, updated_at`` and, if present,
    ``summary``, scope levels, ``memory_layer``, ``status`` and ``feedback`` (the net score).
    """
    terms = T.query_terms(query)
    retrieval = F.lit(0.0) if retrieval is None else retrieval
    parts = [F.coalesce("title", F.lit("")), *([F.coalesce("summary", F.lit(""))] if "summary" in df.columns else [F.lit("")]),
             F.col("content"), F.array_join("tags", " "), F.array_join("entity_keys", " ")]
    matches = T.term_matches(F.lower(F.concat_ws(" ", *parts)), terms)
    among = lambda c: F.size(F.array_intersect(F.transform(F.col(c), F.lower), F.array(*map(F.lit, terms)))) if terms else F.lit(0)
    entity, tag = among("entity_keys"), among("tags")
    score = matches.cast("double") + F.when(retrieval > 0, retrieval * 2.5).otherwise(0.0) + entity * 0.6 + tag * 0.3
    reasons = [F.when(entity > 0, "entity match"), F.when(tag > 0, "tag match")]
    for level, bonus in (("workspace_id", 0.4), ("project_id", 0.6), ("user_id", 0.8), ("session_id", 1.2)):
        if level in df.columns and level in request.scope:
            same = F.coalesce(F.col(level) == request.scope[level], F.lit(False))
            score = score + F.when(same, bonus).otherwise(0.0)
            reasons.append(F.when(same, f"exact {level.removesuffix('_id')} scope"))
    bonus, reason = layer_bonus(df, request)
    score, reasons = score + bonus, [*reasons, reason]
    if "status" in df.columns:
        score = score + F.when(F.col("status") == "active", 0.15).when(F.col("status") == "superseded", -0.2).otherwise(0.0)
        reasons.append(F.when(F.col("status") == "superseded", "superseded memory"))
    if "feedback" in df.columns:
        score = score + F.col("feedback")
        reasons.append(F.when(F.col("feedback") > 0, "positive feedback").when(F.col("feedback") < 0, "negative feedback"))
    score = score + F.least(F.col("importance"), F.lit(1.0)) * 0.25
    score = score + recency_bonus(F.lit(request.as_of).cast("timestamp_ntz"), F.col("updated_at"))
    nothing = (matches == 0) & (retrieval <= 0) if terms else F.lit(False)
    labels = F.array_compact(F.array(*reasons))
    labels = F.when(F.size(labels) == 0, F.array(F.lit("content match"))).otherwise(labels)
    empty = F.array().cast("array<string>")
    return df.withColumns({"score": F.when(nothing, 0.0).otherwise(score), "reasons": F.when(nothing, empty).otherwise(labels)})


def reranked(df: DataFrame, query: str) -> DataFrame:
    """``df`` with ``combined``: its ``score`` and 0.3 times the share of query terms among its words."""
    terms = F.array(*map(F.lit, T.query_terms(query)))
    share = F.size(F.array_intersect(F.array_distinct(T.words(F.col("content"))), terms)) / F.size(terms)
    return df.withColumn("combined", F.col("score") + 0.3 * share)


def abstaining(df: DataFrame, column: str = "combined", least: float = ABSTAIN_BELOW) -> DataFrame:
    """``df``, or nothing of it if its best row stays below ``least``; ``df`` is a top-k list."""
    best = df.agg(F.max(column).alias("best")).first()["best"]
    return df if best is not None and best >= least else df.limit(0)


def contradictions(df: DataFrame, group: str, order: str, column: str, negations: Sequence[str] = T.NEGATIONS) -> DataFrame:
    """``group, a, b, n_shared``: pairs of one group that share terms, exactly one of them negated.

    Joined on the terms themselves, so that texts without a common one never meet; a pair's
    common terms are added up before they are shuffled.
    """
    no = F.array(*map(F.lit, negations))
    rows = df.select(F.col(group), F.col(order).alias("_at"), F.array_distinct(T.words(F.col(column))).alias("_w"))
    terms = rows.select(group, "_at", F.arrays_overlap("_w", no).alias("_no"), F.explode(F.array_except("_w", no)).alias("_t"))
    negated = terms.where("_no").select(group, "_t", F.col("_at").alias("x"))
    plain = terms.where("NOT _no").select(group, "_t", F.col("_at").alias("y"))
    pairs = negated.join(plain, [group, "_t"]).select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.groupBy(group, "a", "b").agg(F.count("*").alias("n_shared"))


def citation(source_type: Column, source_id: Column, title: Column, uri: Column) -> Column:
    return F.concat(
        source_type, F.lit(":"), source_id,
        F.coalesce(F.concat(F.lit(" ("), title, F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" <"), uri, F.lit(">")), F.lit("")),
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """``node, other, direction`` of each edge seen from either end."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction")).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("direction"))
    )


def _blocks(vectors: DataFrame, key: str, column: str, rows: int) -> DataFrame:
    """``dim, keys, matrix``: up to ``rows`` vectors of one length as bytes; without components that count, zeros."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column("key").to_numpy(zero_copy_only=False), batch.column("v").to_pylist()
            sizes = np.array([len(v) for v in values])
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                for part in (own[i : i + rows] for i in range(0, len(own), rows)):
                    numbers = np.array([[np.nan] * dim if any(x is None for x in values[i]) else values[i] for i in part], np.float64).reshape(len(part), dim)
                    null = np.array([any(x is None for x in values[i]) for i in part])
                    numbers[null] = 0.0
                    yield pa.RecordBatch.from_pydict({"dim": [int(dim)], "keys": [keys[part].astype(np.int64).tobytes()], "matrix": [numbers.tobytes()]})

    usable = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v"))
    return saved(usable.mapInArrow(pack, "dim long, keys binary, matrix binary"))


def _sized(matrix: np.ndarray) -> np.ndarray:
    total = np.zeros(len(matrix))
    for d in range(matrix.shape[1]):
        total += matrix[:, d] * matrix[:, d]
    return np.sqrt(total)


def _near(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of two blocks, added up in the order of components as ``V.cosine`` does; 0 for zero vectors."""
    total = np.zeros((len(q), len(v)))
    for d in range(q.shape[1]):
        total += q[:, d, None] * v[None, :, d]
    sizes = _sized(q)[:, None] * _sized(v)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sizes == 0, 0.0, total / sizes)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", block: int = 2048, column: str = "embedding") -> DataFrame:
    """``query, key, similarity, place``: for each query vector its ``k`` nearest other vectors.

    Keys are whole numbers. Every pair of a block of queries and one of vectors is a row, whose
    cosines are found at once; of them go on, for each query, those that similarities rounded to
    six places may put among its ``k`` best, of equal ones the ``k`` smallest keys. The work is
    that of all pairs, in bounded memory and over all tasks.
    """

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, others = (np.frombuffer(row[c], np.int64) for c in ("_ids", "keys"))
                q, v = (np.frombuffer(row[c], np.float64).reshape(len(n), row["dim"]) for c, n in (("_queries", ids), ("matrix", others)))
                order = np.argsort(others, kind="stable")
                others, v = others[order], v[order]
                for a in range(0, len(ids), 64):
                    near = _near(q[a : a + 64], v)
                    near[np.isnan(near)] = np.inf  # before all numbers, as in Spark's order
                    near[ids[a : a + 64, None] == others[None, :]] = -np.inf
                    least = np.partition(near, -k, axis=1)[:, -k] if len(others) > k else np.full(len(near), -np.inf)
                    at, to = np.nonzero((near >= least[:, None] - 2e-6) & (near > -np.inf))
                    value = near[at, to]
                    place = np.lexsort((to, -value, at))
                    at, to, value = at[place], to[place], value[place]
                    begins = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (value[1:] != value[:-1])]) if len(at) else np.zeros(0, np.int64)
                    rank = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
                    use = rank < k
                    value = np.where(np.isinf(value), np.nan, value)[use]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + at[use]]), pa.array(others[to[use]]), pa.array(value)], ["query", key, "similarity"])

    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = _blocks(queries, key, column, block).select(F.col("dim").alias("_dim"), F.col("keys").alias("_ids"), F.col("matrix").alias("_queries"))
    pairs = _blocks(vectors, key, column, block).repartition(spread).crossJoin(own).where("dim = _dim").drop("_dim")
    rows = pairs.mapInArrow(hold, f"query long, {key} long, similarity double").withColumn("similarity", F.round("similarity", 6))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), F.asc(key))
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)

"""One search: from a query to ranked, explained records, and the read path that cites and packs them.

Candidates come from keywords, ranked as a full-text index of five columns ranks them, and from
vectors; each list holds five times as many records as are asked for. If both are empty, the
newest records in scope stand in. Candidates are then judged, scored and cut to the limit.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from . import retrieval as R
from .filters import Request, in_scope, live, rejection_reasons
from .keyword_index import GAP, LEAST_IDF, folded, phrases
from .ledger import saved
from .lifecycle import Hold, hold_states

#: The indexed columns, and how many more candidates each source gives.
INDEXED = ("title", "summary", "content", "tags", "entity_keys")
CANDIDATES, NEAREST, NEWEST = 5, 10, 6
EXCERPT = 200
_TOKEN = r"[\p{L}\p{N}]+"


def is_procedure(metadata: Column, projection: str = "$.projection", data: str = "$.event.structured_data") -> Column:
    """Whether a record of the ledger's projection holds a procedure or the outcome of one.

    ``metadata`` is JSON text. A key with a JSON null counts as present; metadata that isn't
    JSON, or is missing, holds nothing.
    """
    keys = F.json_object_keys(F.get_json_object(metadata, data))
    named = F.arrays_overlap(keys, F.array(F.lit("procedure"), F.lit("procedureOutcome")))
    return F.coalesce(F.get_json_object(metadata, projection) == "repo-ledger", F.lit(False)) & F.coalesce(named, F.lit(False))


def indexed_text(df: DataFrame) -> Column:
    """The indexed columns of a record as one text, with a mark between columns that no phrase crosses."""
    whole = []
    for name in INDEXED:
        if name in df.columns:
            joined = F.array_join(name, "\n") if df.schema[name].dataType.typeName() == "array" else F.col(name)
            whole.append(F.coalesce(joined, F.lit("")))
    return folded(F.concat_ws(f"\n{GAP}\n", *whole))


def keyword_rank(records: DataFrame, query: str, keep: Sequence[str] = ("memory_id",)) -> DataFrame:
    """``keep`` and ``rank``, negative and the lower the better, of records that have a query term.

    BM25 over all indexed columns as one, with the inverse document frequency ln((N - n + 0.5) /
    (n + 0.5)), 0.000001 at least. Latin letters count without their marks. A term that holds punctuation is a phrase of its parts. Each
    row is counted once and kept as a few numbers; the totals are one row.
    """
    wanted = phrases(query)
    if not wanted:
        return records.select(*keep, F.lit(0.0).alias("rank")).limit(0)
    gap = r"[^\p{L}\p{N}\x00]+"
    pattern = lambda p: F.lit(r"(?<![\p{L}\p{N}])" + gap.join(map(re.escape, p)) + r"(?![\p{L}\p{N}])")
    text = records.select(*keep, indexed_text(records).alias("_text"))
    counted = saved(
        text.select(
            *keep, F.regexp_count("_text", F.lit(_TOKEN)).alias("_n"),
            *[F.regexp_count("_text", pattern(p)).alias(f"_tf{i}") for i, p in enumerate(wanted)],
        )
    )
    totals = counted.agg(
        F.count("*").alias("n"), F.avg("_n").alias("mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]
    ).first()
    n, mean, score = totals["n"], totals["mean"] or 1.0, F.lit(0.0)
    found = F.lit(False)
    for i in range(len(wanted)):
        df, tf = totals[f"df{i}"], F.col(f"_tf{i}")
        idf = F.greatest(F.log(F.lit((n - df + 0.5) / (df + 0.5))), F.lit(LEAST_IDF))
        score = score + idf * tf * F.lit(R.K1 + 1) / (tf + F.lit(R.K1) * (F.lit(1 - R.B) + F.lit(R.B) * F.col("_n") / F.lit(mean)))
        found = found | (tf > 0)
    return counted.where(found).select(*keep, (-score).alias("rank"))


def visible(records: DataFrame, request: Request) -> DataFrame:
    """Records in the request's scope that are neither deleted, retracted nor procedures."""
    ok = in_scope(records, request)
    if "status" in records.columns and not request.include_deleted:
        ok = ok & ~F.col("status").isin("deleted", "retracted")
    if "metadata" in records.columns:
        ok = ok & ~is_procedure(F.col("metadata"))
    return records.where(ok)


def keyword_candidates(records: DataFrame, request: Request, query: str, ranked: DataFrame | None = None) -> DataFrame:
    """``memory_id, fts``: the best visible records by keyword rank. The index knows all records.

    ``ranked`` has the ranks of a stored index (``keyword_index.rank``); without it all texts are read.
    """
    ranked = keyword_rank(records, query) if ranked is None else ranked
    seen = visible(records, request).select("memory_id", "updated_at").join(ranked, "memory_id")
    best = R.top(seen, CANDIDATES * request.limit, F.asc("rank"), F.desc("updated_at"), F.asc("memory_id"))
    return best.select("memory_id", R.keyword_score(F.col("rank")).alias("fts"))


def vector_candidates(records: DataFrame, request: Request, embedding: Sequence[float] | None, scan: bool = False) -> DataFrame:
    """``memory_id, vec``: visible records with a positive cosine, the most similar first.

    The nearest of all tenants are fetched first, fifty for each record asked for, and filtered
    after. With ``scan``, the newest visible records with an embedding are compared instead.
    """
    n = CANDIDATES * request.limit
    none = records.select("memory_id", F.lit(0.0).alias("vec")).limit(0)
    if not embedding or "embedding" not in records.columns:
        return none
    similarity = F.when(F.size("embedding") == len(embedding), V.cosine(F.col("embedding"), V.literal(embedding))).otherwise(0.0)
    seen = visible(records.where(F.size("embedding") > 0), request)
    if scan:
        near = R.top(seen, NEWEST * n, F.desc("updated_at"), F.asc("memory_id")).select("memory_id", "updated_at", similarity.alias("vec"))
    else:
        near = R.top(records.where(F.size("embedding") > 0).select("memory_id", similarity.alias("vec")), NEAREST * n, F.desc("vec"), F.asc("memory_id"))
        near = seen.select("memory_id", "updated_at").join(F.broadcast(near), "memory_id")
    return R.top(near.where("vec > 0"), n, F.desc("vec"), F.desc("updated_at"), F.asc("memory_id")).select("memory_id", "vec")


def candidates(
    records: DataFrame, request: Request, query: str, embedding: Sequence[float] | None = None, scan: bool = False, ranked: DataFrame | None = None
) -> DataFrame:
    """``memory_id, fts, vec, strategy``: the union of both lists, or the newest visible records if both are empty.

    At most ten times as many rows as are asked for. ``ranked`` has ranks of a stored index.
    """
    fts = saved(keyword_candidates(records, request, query, ranked))
    vec = saved(vector_candidates(records, request, embedding, scan))
    by_words, by_vector = not fts.isEmpty(), not vec.isEmpty()
    if by_words or by_vector:
        label = "hybrid" if by_words and by_vector else "fts" if by_words else "vector"
        return R.merge_candidates(fts, vec).select("memory_id", "fts", "vec", F.lit(label).alias("strategy"))
    newest = R.top(visible(records, request), CANDIDATES * request.limit, F.desc("updated_at"), F.asc("memory_id"))
    zero = F.lit(0.0)
    return newest.select("memory_id", zero.alias("fts"), zero.alias("vec"), F.lit("recency_fallback").alias("strategy"))


def held_afresh(records: DataFrame, ids: DataFrame, holds: Sequence[Hold], as_of: str) -> DataFrame:
    """``records`` with the states of those of ``ids`` (``memory_id``, a limited list) as the holds of now have them.

    A covered record is held, and keeps in ``pre_hold_status`` what it was; one that no hold
    covers any more is again what it was, or active. ``holds`` name tenants among their scope.
    """
    had = "pre_hold_status" in records.columns
    before = F.col("pre_hold_status") if had else F.lit(None).cast("string")
    named = F.broadcast(ids.select("memory_id", F.lit(True).alias("_asked")).distinct())
    rows = records.join(named, "memory_id", "left")
    covered = hold_states(rows.where("_asked"), holds, as_of).select("memory_id", F.lit(True).alias("_covered"))
    rows = rows.join(F.broadcast(covered), "memory_id", "left")
    plain = F.coalesce(before, F.when(F.col("status") == "held", "active").otherwise(F.col("status")))
    status = F.when(F.col("_covered"), "held").when(F.col("_asked"), plain).otherwise(F.col("status"))
    kept = F.when(F.col("_covered"), plain).when(F.col("_asked"), None).otherwise(before)
    return rows.withColumns({"status": status, "pre_hold_status": kept}).drop("_asked", "_covered")


def related(records: DataFrame, relations: DataFrame, found: DataFrame, as_of: str, denied: Column | None = None) -> DataFrame:
    """``memory_id, relation, other``: what found records relate to, in either direction.

    ``relations`` has ``src, dst, relation``; ``found`` is a limited list. Left out are others
    that are deleted, retracted, outside of their validity, expired, procedures, or denied.
    """
    ids = F.broadcast(found.select("memory_id").distinct())
    out = relations.select(F.col("src").alias("memory_id"), "relation", F.col("dst").alias("other")).join(ids, "memory_id")
    back = relations.select(F.col("dst").alias("memory_id"), "relation", F.col("src").alias("other")).join(ids, "memory_id")
    now, ok = F.lit(as_of).cast("timestamp_ntz"), F.lit(True)
    if "status" in records.columns:
        ok = ok & ~F.col("status").isin("deleted", "retracted")
    for name, bad in (("valid_from", F.col("valid_from") > now), ("valid_to", F.col("valid_to") < now), ("expires_at", F.col("expires_at") <= now)):
        if name in records.columns:
            ok = ok & ~F.coalesce(bad, F.lit(False))
    if "metadata" in records.columns:
        ok = ok & ~is_procedure(F.col("metadata"))
    if denied is not None:
        ok = ok & ~denied
    seen = records.where(ok).select(F.col("memory_id").alias("other"))
    return out.unionByName(back).join(seen, "other").select("memory_id", "relation", "other")


def evaluated(
    records: DataFrame, request: Request, query: str, embedding: Sequence[float] | None = None, scan: bool = False, denied: Column | None = None,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """The candidates as ``records`` rows with ``fts, vec, strategy, score, reasons, rejections``.

    ``denied`` tells which records the caller may not read. A keyword candidate with an
    embedding gets its own cosine. ``reasons`` begin with those of retrieval.
    """
    found = candidates(records, request, query, embedding, scan, ranked)
    rows = records.join(F.broadcast(found), "memory_id")
    if embedding and "embedding" in records.columns:
        own = F.when(F.size("embedding") == len(embedding), V.cosine(F.col("embedding"), V.literal(embedding)))
        rows = rows.withColumn("vec", F.when(F.col("vec") > 0, F.col("vec")).otherwise(F.coalesce(own, F.lit(0.0))))
    fts, vec = F.col("fts"), F.col("vec")
    out = R.scored(rows, request, query, R.fused(fts, vec))
    how = F.array_compact(
        F.array(F.when(fts > 0, "fts match"), F.when(vec > 0, "vector similarity"), F.when((fts > 0) & (vec > 0), "hybrid retrieval"))
    )
    against = rejection_reasons(rows, request, denied)
    unmatched = F.array_compact(F.array(F.when(F.col("score") <= 0, "query terms not present")))
    out = out.withColumn("rejections", F.when(F.size(against) > 0, against).otherwise(unmatched))
    return out.withColumn("reasons", F.concat(how, "reasons"))


def search(
    records: DataFrame, request: Request, query: str, embedding: Sequence[float] | None = None, scan: bool = False, denied: Column | None = None,
    ranked: DataFrame | None = None, holds: Sequence[Hold] | None = None,
) -> DataFrame:
    """The records that answer a query, best first: ``records`` with ``fts, vec, strategy, score, reasons``.

    ``records`` needs ``memory_id, tenant_id, title, content, tags, entity_keys, importance,
    updated_at``; ``summary, status, metadata, embedding``, scope levels, validity and
    ``created_at`` are used if present. At most ``request.limit`` rows, by score, then newest.
    With ``holds`` the candidates' states are renewed as of the request's time, and candidates
    looked for once more among the records as they are then. ``ranked`` has ranks of a stored
    index; without it all texts are read.
    """
    if holds is not None:
        ranked = saved(keyword_rank(records, query)) if ranked is None else ranked
        first = candidates(records, request, query, embedding, scan, ranked)
        records = held_afresh(records, first, holds, request.as_of)
    accepted = evaluated(records, request, query, embedding, scan, denied, ranked).where(F.size("rejections") == 0).drop("rejections")
    newest = [F.desc("updated_at"), *([F.desc("created_at")] if "created_at" in records.columns else [])]
    return R.top(accepted, request.limit, F.desc("score"), *newest, F.asc("memory_id"))


def blended(found: DataFrame, limit: int, embedding: Sequence[float] | None = None, vector_weight: float = R.VECTOR_WEIGHT) -> DataFrame:
    """``found`` with ``combined``: the search's score, as it is, and the cosine, weighed; the best first."""
    own = F.lit(0.0)
    if embedding and "embedding" in found.columns:
        cosine = F.when(F.size("embedding") == len(embedding), V.cosine(F.col("embedding"), V.literal(embedding)))
        own = F.coalesce(cosine, F.lit(0.0))
    combined = (1 - vector_weight) * F.col("score") + vector_weight * own
    return R.top(found.withColumn("combined", combined), limit, F.desc("combined"), F.asc("memory_id"))


def citations(found: DataFrame) -> DataFrame:
    """``memory_id, title, excerpt, source_references, confidence`` of blended records."""
    sources = F.col("source_references") if "source_references" in found.columns else F.expr("cast(array() as array<string>)")
    return found.select(
        "memory_id", F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("content", F.lit("")), 1, EXCERPT).alias("excerpt"),
        sources.alias("source_references"), F.col("combined").alias("confidence"),
    )


def within_budget(found: DataFrame, most: int, order: Sequence[Column]) -> DataFrame:
    """``memory_id, tokens``: records in rank order, each taken if it still fits. ``found`` is a limited list.

    The fallback when no budget service answers: a quarter of the length as tokens, one at least.
    """
    ranked = found.select("memory_id", T.char_tokens(F.col("content")).alias("tokens"), F.struct(*order).alias("_rank"))
    items = ranked.agg(F.array_sort(F.collect_list(F.struct("_rank", "memory_id", "tokens"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<int>)").alias("taken"))

    def step(at: Column, x: Column) -> Column:
        fits = at["used"] + x["tokens"] <= most
        return F.struct(
            F.when(fits, at["used"] + x["tokens"]).otherwise(at["used"]).alias("used"),
            F.concat(at["taken"], F.array(F.when(fits, 1).otherwise(0))).alias("taken"),
        )

    packed = items.select("items", F.aggregate("items", start, step, lambda at: at["taken"]).alias("taken"))
    each = packed.select(F.explode(F.arrays_zip("items", "taken")).alias("x")).where("x.taken = 1")
    return each.select("x.items.memory_id", "x.items.tokens")

"""Queries: filters, access and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import filters as L
from ..operators import retrieval as R
from ..sources.projections import AS_OF, GRAPH_SQL, RECORDS_SQL, feedback, place_graph, records, table

QUERY = "the tion, and"
EN_SRC3 = L.Request(tenant_id="en", scope={"project_id": "src3"}, as_of=AS_OF)


def scope_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = records(spark, sf_dir, with_status=True)
    return df.where(L.in_scope(df, EN_SRC3) & L.live(df)).select("memory_id", "project_id", "status")


def validity_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("INTERVAL '1' DAY")
    begun = F.col("o_orderdate").cast("timestamp_ntz")
    ends = F.when(F.col("o_orderstatus") != "O", begun + day * 90)
    expires = F.when(F.col("o_orderpriority") == "1-URGENT", begun + day * 30)
    ok = L.valid_at(F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), begun, ends, expires)
    return table(spark, sf_dir, "orders").where(ok).select("o_orderkey", "o_orderstatus")


def tags_all_entities_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = records(spark, sf_dir)
    ok = L.has_all_tags(F.col("tags"), ["en"]) & L.has_any_entity(F.col("entity_keys"), ["src3", "src5", "src7"])
    return df.where(ok).select("memory_id")


def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = L.Request(tenant_id="en", scope={"project_id": "src3"}, tags=("src3", "urgent"), entity_keys=("src3",), as_of="2024-01-10 00:00:00")
    df = records(spark, sf_dir).withColumn("valid_from", F.col("updated_at"))
    return df.select("memory_id", F.array_join(L.rejection_reasons(df, request), "; ").alias("reasons"))


def bm25_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.bm25(records(spark, sf_dir), QUERY).withColumn("bm25", F.round("bm25", 6))
    return R.top(found, 10, F.desc("bm25"), F.asc("memory_id"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row["embedding"]]


def vector_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.neighbours(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), ["vec_id"])
    return R.top(found.withColumn("similarity", F.round("similarity", 6)), 10, F.desc("similarity"), F.asc("vec_id"))


def hybrid_fusion_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    fts = R.bm25(records(spark, sf_dir), QUERY).withColumn("bm25", F.round("bm25", 6))
    fts = R.top(fts, 50, F.desc("bm25"), F.asc("memory_id")).select("memory_id", R.keyword_score(F.col("bm25")).alias("fts"))
    vec = R.neighbours(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), ["vec_id"])
    vec = vec.select(F.col("vec_id").alias("memory_id"), F.round("similarity", 6).alias("vec"))
    vec = R.top(vec, 50, F.desc("vec"), F.asc("memory_id"))
    merged = R.merge_candidates(fts, vec)
    return merged.select("memory_id", *[F.round(c, 6).alias(c) for c in ("fts", "vec", "score")], "strategy")


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {k: F.count_if(F.col("feedback_type") == k) for k in ("positive", "negative", "correction", "pin")}
    summed = feedback(spark, sf_dir).groupBy("memory_id").agg(*[v.alias(k) for k, v in kinds.items()])
    return summed.withColumn("net", R.feedback_net(*[F.col(k) for k in kinds]))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = feedback_summary(spark, sf_dir).select("memory_id", F.col("net").alias("feedback"))
    df = records(spark, sf_dir, with_status=True).join(net, "memory_id", "left").fillna(0.0, ["feedback"])
    return R.scored(df, EN_SRC3, "src3, idiot and")


def record_score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("memory_id", F.round("score", 4).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


def search_explain_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record, with its rank if it is among the ten returned, or why it isn't."""
    df = _scored(spark, sf_dir).withColumn("score", F.round("score", 4))
    df = df.withColumn("accepted", L.in_scope(df, EN_SRC3) & L.live(df) & (F.col("score") > 0))
    best = R.top(df.where("accepted"), 10, F.desc("score"), F.desc("updated_at"), F.asc("memory_id")).select("memory_id", F.lit(True).alias("shown"))
    state = F.when(F.col("shown"), "returned").when(F.col("accepted"), "not_returned").otherwise("filtered_out")
    return df.join(F.broadcast(best), "memory_id", "left").select("memory_id", "score", state.alias("state"))


def rerank_term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.bm25(records(spark, sf_dir), QUERY, ["memory_id", "content"]).withColumn("bm25", F.round("bm25", 6))
    first = R.top(ranked, 50, F.desc("bm25"), F.asc("memory_id")).withColumn("score", R.keyword_score(F.col("bm25")))
    again = R.reranked(first, QUERY).select("memory_id", F.round("combined", 6).alias("combined"))
    return R.abstaining(R.top(again, 10, F.desc("combined"), F.asc("memory_id")))


def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = R.contradictions(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return pairs.select("conv_id", F.col("a").alias("turn_a"), F.col("b").alias("turn_b"), "n_shared")


def recency_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither terms nor vectors match, so the newest records in scope are returned."""
    df = records(spark, sf_dir, with_status=True)
    if not R.bm25(df, "zzzzz").isEmpty():
        raise RuntimeError("the query was to match nothing")
    newest = R.top(df.where(L.in_scope(df, EN_SRC3) & L.live(df)), 10, F.desc("updated_at"), F.asc("memory_id"))
    return newest.select("memory_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"), F.lit("recency_fallback").alias("strategy"))


def related_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = R.both_directions(place_graph(spark, sf_dir))
    return seen.groupBy("node", "direction").agg(F.count("*").alias("n"), F.min("other").alias("first_other"))


def acl_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of their customer's nation, listed for the customer unless urgent."""
    entry = F.struct(
        F.col("o_custkey").cast("string").alias("principal_id"), F.lit("user").alias("principal_type"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("read"))).otherwise(F.array(F.lit("admin"))).alias("permissions"),
    )
    segment = F.struct(
        F.col("c_mktsegment").alias("principal_id"), F.lit("group").alias("principal_type"), F.array(F.lit("read")).alias("permissions")
    )
    acl = F.when(F.col("o_orderpriority") == "1-URGENT", F.array().cast(
        "array<struct<principal_id:string,principal_type:string,permissions:array<string>>>"
    )).otherwise(F.array(entry, segment))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumns({"acl": acl, "tenant_id": F.col("c_nationkey").cast("string")})
    caller = A.Caller(principal_id="7", tenant_id="3", groups=("BUILDING",))
    return rows.where(A.can_access(caller)).select("o_orderkey", "o_custkey", "o_orderpriority")


def source_grants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are readable if all suppliers of their lines grant more than a view to someone."""
    lines = table(spark, sf_dir, "lineitem")
    level = F.when(F.col("l_returnflag") == "A", "owner").when(F.col("l_returnflag") == "N", "edit").otherwise("view")
    source = F.concat_ws(":", "l_suppkey", F.col("l_partkey") % 10)
    sources = lines.select(F.col("l_orderkey").alias("memory_id"), source.alias("source_id"))
    grants = lines.select(source.alias("source_id"), F.concat(F.lit("p"), F.col("l_linenumber")).alias("principal_id"), level.alias("permission_level"))
    found = A.source_grants(sources, grants, ["p1", "p2"], "edit")
    return found.select(F.col("memory_id").alias("o_orderkey"), "n_sources", "n_granted", "allowed")


def expanded_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("connector_id"), F.col("c_mktsegment").alias("local_principal_id"),
        F.col("c_name").alias("remote_principal_id"), F.array(F.concat(F.lit("group:"), F.col("c_custkey") % 3)).alias("groups"),
    )
    return A.expanded_principals(mapped).select("connector_id", "local_principal_id", F.size("principals").cast("long").alias("n_principals"))


QUERIES = {
    f.__name__: f
    for f in (
        scope_status_filter, validity_window_filter, tags_all_entities_any, rejection_reasons, bm25_search_topk, vector_knn_topk,
        hybrid_fusion_merge, feedback_summary, record_score_reasons, search_explain_partition, rerank_term_overlap,
        contradiction_pairs, recency_fallback, related_union, acl_row_filter, source_grants_all, expanded_principals,
    )
}

_BM25 = r"""WITH counted AS (
  SELECT doc_id AS memory_id, text, list_filter(string_split_regex(lower(text), '[ \t\n\f\r]+'), lambda w: w <> '') AS w FROM documents
), tf AS (
  SELECT memory_id, text, w, len(w) AS n, len(list_filter(w, lambda x: x = 'and')) AS t0, len(list_filter(w, lambda x: x = 'the')) AS t1,
         len(list_filter(w, lambda x: x = 'tion')) AS t2 FROM counted
), totals AS (
  SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM tf
), ranked AS (
  SELECT memory_id, w, round(
    ln(1 + (docs - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * t0 * 2.2::DOUBLE / (t0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))
  + ln(1 + (docs - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * t1 * 2.2::DOUBLE / (t1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))
  + ln(1 + (docs - d2 + 0.5::DOUBLE) / (d2 + 0.5::DOUBLE)) * t2 * 2.2::DOUBLE / (t2 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)), 6) AS bm25
  FROM tf, totals WHERE t0 + t1 + t2 > 0
)"""
_FEEDBACK = """summed AS (
  SELECT doc_id AS memory_id, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality <> 1) AS negative,
         count(*) FILTER (toxic = 1) AS correction, 0::BIGINT AS pin FROM labels GROUP BY 1
), feedback AS (
  SELECT *, round(least(positive * 0.12::DOUBLE, 0.6) - least(negative * 0.15::DOUBLE, 0.6) + least(correction * 0.05::DOUBLE, 0.25) + least(pin * 0.4::DOUBLE, 0.8), 4) AS net
  FROM summed
)"""
_NEAR = """near AS (
  SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings
)"""
_SCORED = f"""WITH {RECORDS_SQL}, {_FEEDBACK}, hay AS (
  SELECT m.*, coalesce(net, 0) AS net, lower(title || '  ' || content || ' ' || tenant_id || ' ' || project_id || ' ' || project_id) AS h
  FROM memories m LEFT JOIN feedback USING (memory_id)
), counted AS (
  SELECT *, contains(h, 'src3')::INT + contains(h, 'idiot')::INT + contains(h, 'and')::INT AS matches,
         (project_id = 'src3')::INT AS own, date_diff('day', updated_at, TIMESTAMP '2024-02-01') AS age FROM hay
), scored AS (
  SELECT *, CASE WHEN matches = 0 THEN 0.0::DOUBLE ELSE round(matches + own * 0.6::DOUBLE + own * 0.3::DOUBLE + own * 0.6::DOUBLE + 0.35::DOUBLE
      + CASE status WHEN 'active' THEN 0.15::DOUBLE ELSE -0.2::DOUBLE END + net + least(importance, 1) * 0.25::DOUBLE
      + CASE WHEN age <= 1 THEN 0.3::DOUBLE WHEN age <= 7 THEN 0.15::DOUBLE WHEN age <= 30 THEN 0.05::DOUBLE ELSE 0::DOUBLE END, 4) END AS score
  FROM counted
)"""

ORACLES = {
    "scope_status_filter": f"WITH {RECORDS_SQL} SELECT memory_id, project_id, status FROM memories WHERE tenant_id = 'en' AND (project_id IS NULL OR project_id = 'src3') AND status NOT IN ('deleted', 'retracted')",
    "validity_window_filter": """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-01'
AND (o_orderstatus = 'O' OR o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1998-06-01') AND (o_orderpriority <> '1-URGENT' OR o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-06-01')""",
    "tags_all_entities_any": "SELECT doc_id AS memory_id FROM documents WHERE (lang = 'en' OR source = 'en') AND source IN ('src3', 'src5', 'src7')",
    "rejection_reasons": f"""WITH {RECORDS_SQL} SELECT memory_id, array_to_string(list_filter([
  CASE WHEN tenant_id <> 'en' OR project_id <> 'src3' THEN 'scope mismatch' END,
  CASE WHEN project_id = 'src3' THEN 'missing tags: urgent' ELSE 'missing tags: src3, urgent' END,
  CASE WHEN project_id <> 'src3' THEN 'entity keys filtered' END,
  CASE WHEN updated_at > TIMESTAMP '2024-01-10' THEN 'not yet valid' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM memories""",
    "bm25_search_topk": f"{_BM25} SELECT memory_id, bm25 FROM ranked ORDER BY bm25 DESC, memory_id LIMIT 10",
    "vector_knn_topk": f"WITH {_NEAR} SELECT vec_id, similarity FROM near WHERE similarity > 0 ORDER BY similarity DESC, vec_id LIMIT 10",
    "hybrid_fusion_merge": f"""{_BM25}, {_NEAR}, a AS (
  SELECT memory_id, bm25 / (1 + bm25) AS fts FROM (SELECT * FROM ranked ORDER BY bm25 DESC, memory_id LIMIT 50)
), b AS (
  SELECT vec_id AS memory_id, similarity AS vec FROM (SELECT * FROM near WHERE similarity > 0 ORDER BY similarity DESC, vec_id LIMIT 50)
), both_lists AS (
  SELECT memory_id, coalesce(fts, 0) AS fts, coalesce(vec, 0) AS vec FROM a FULL JOIN b USING (memory_id)
)
SELECT memory_id, round(fts, 6) AS fts, round(vec, 6) AS vec,
       round(CASE WHEN fts > 0 AND vec > 0 THEN 0.55::DOUBLE * fts + 0.45::DOUBLE * vec WHEN vec > 0 THEN vec ELSE fts END, 6) AS score,
       CASE WHEN fts > 0 AND vec > 0 THEN 'hybrid' WHEN vec > 0 THEN 'vector' ELSE 'fts' END AS strategy FROM both_lists""",
    "feedback_summary": f"WITH {_FEEDBACK} SELECT memory_id, positive, negative, correction, pin, net FROM feedback",
    "record_score_reasons": f"""{_SCORED} SELECT memory_id, score, CASE WHEN matches = 0 THEN '' ELSE array_to_string(list_filter([
  CASE WHEN own = 1 THEN 'entity match' END, CASE WHEN own = 1 THEN 'tag match' END, CASE WHEN own = 1 THEN 'exact project scope' END,
  'organization layer', CASE WHEN status = 'superseded' THEN 'superseded memory' END,
  CASE WHEN net > 0 THEN 'positive feedback' WHEN net < 0 THEN 'negative feedback' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM scored""",
    "search_explain_partition": f"""{_SCORED}, judged AS (
  SELECT *, tenant_id = 'en' AND project_id = 'src3' AND score > 0 AS accepted FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY accepted ORDER BY score DESC, updated_at DESC, memory_id) AS k FROM judged
)
SELECT memory_id, score, CASE WHEN accepted AND k <= 10 THEN 'returned' WHEN accepted THEN 'not_returned' ELSE 'filtered_out' END AS state FROM ranked""",
    "rerank_term_overlap": f"""{_BM25}, firsts AS (SELECT * FROM ranked ORDER BY bm25 DESC, memory_id LIMIT 50), again AS (
  SELECT memory_id, round(bm25 / (1 + bm25) + 0.3::DOUBLE * (list_contains(w, 'and')::INT + list_contains(w, 'the')::INT + list_contains(w, 'tion')::INT) / 3, 6) AS combined FROM firsts
) SELECT memory_id, combined FROM again WHERE (SELECT max(combined) FROM again) >= 0.15 ORDER BY combined DESC, memory_id LIMIT 10""",
    "contradiction_pairs": """WITH t AS (
  SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\f\\r]+'), lambda w: w <> '')) AS w FROM conversations
), n AS (
  SELECT conv_id, turn, list_filter(w, lambda x: x NOT IN ('not', 'never', 'no', 'don''t', 'doesn''t', 'isn''t', 'wasn''t', 'aren''t', 'won''t', 'can''t', 'cannot')) AS t, w FROM t
), m AS (SELECT *, len(t) < len(w) AS neg FROM n)
SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, len(list_intersect(a.t, b.t)) AS n_shared
FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.neg <> b.neg WHERE len(list_intersect(a.t, b.t)) > 0""",
    "recency_fallback": f"""WITH {RECORDS_SQL} SELECT memory_id, strftime(updated_at, '%Y-%m-%d') AS updated, 'recency_fallback' AS strategy FROM memories
WHERE tenant_id = 'en' AND project_id = 'src3' ORDER BY updated_at DESC, memory_id LIMIT 10""",
    "acl_row_filter": """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_nationkey = 3 AND (o_orderpriority = '1-URGENT' OR o_custkey = 7 OR c_mktsegment = 'BUILDING')""",
    "source_grants_all": """WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey || ':' || (l_partkey % 10) AS source_id FROM lineitem),
g AS (SELECT DISTINCT l_suppkey || ':' || (l_partkey % 10) AS source_id FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linenumber IN (1, 2))
SELECT l_orderkey AS o_orderkey, count(*) AS n_sources, count(g.source_id) AS n_granted, count(*) = count(g.source_id) AS allowed
FROM s LEFT JOIN g USING (source_id) GROUP BY 1""",
    "expanded_principals": """SELECT connector_id, local_principal_id, count(DISTINCT name) AS n_principals FROM (
  SELECT c_nationkey AS connector_id, c_mktsegment AS local_principal_id, unnest([c_mktsegment, c_name, 'group:' || (c_custkey % 3)]) AS name FROM customer) GROUP BY 1, 2""",
}

ORACLES["related_union"] = f"""WITH {GRAPH_SQL}, seen AS (
  SELECT src AS node, dst AS other, 'out' AS direction FROM edges UNION ALL SELECT dst, src, 'in' FROM edges
) SELECT node, direction, count(*) AS n, min(other) AS first_other FROM seen GROUP BY 1, 2"""

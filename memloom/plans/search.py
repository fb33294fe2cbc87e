"""Queries: search from end to end, its keyword rank, blend, citations and budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as L
from ..operators import retrieval as R
from ..operators import search as S
from ..operators.ledger import saved
from ..sources.projections import RECORDS_SQL, records, table
from .retrieval import EN_SRC3, QUERY, _query_vector


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with their embeddings, stored once, as a search finds them."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding")
    return saved(records(spark, sf_dir, with_status=True).join(vectors, "memory_id", "left"))


def bm25_five_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = S.keyword_rank(records(spark, sf_dir), "the don't, src3")
    return R.top(ranked.select("memory_id", F.round("rank", 6).alias("rank")), 20, F.asc("rank"), F.asc("memory_id"))


def _found(spark: SparkSession, sf_dir: str, query: str = QUERY, scan: bool = False) -> DataFrame:
    return S.search(_with_vectors(spark, sf_dir), EN_SRC3, query, _query_vector(spark, sf_dir), scan)


def _shown(found: DataFrame) -> DataFrame:
    rounded = [F.round(c, 4).alias(c) for c in ("fts", "vec", "score")]
    return found.select("memory_id", *rounded, "strategy", F.array_join("reasons", "; ").alias("reasons"))


def search_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_found(spark, sf_dir))


def search_newest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector side looks at the newest records only."""
    return _shown(_found(spark, sf_dir, scan=True))


def search_without_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No terms and no vector: the newest records in scope stand in."""
    return _shown(S.search(_with_vectors(spark, sf_dir), EN_SRC3, ""))


def search_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of a narrower request, with what speaks against it."""
    request = L.Request(tenant_id="en", scope={"project_id": "src3"}, tags=("urgent",), limit=10)
    found = S.evaluated(_with_vectors(spark, sf_dir), request, QUERY, denied=F.col("memory_id") % 3 == 0)
    return found.select("memory_id", F.array_join("rejections", "; ").alias("rejections"))


def pipeline_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = S.blended(_found(spark, sf_dir), 5, _query_vector(spark, sf_dir))
    return S.citations(best).select("memory_id", "title", "excerpt", F.round("confidence", 4).alias("confidence"))


def rank_order_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir).withColumn("score", F.round("score", 4))
    return S.within_budget(found, 600, [-F.col("score"), F.col("memory_id")])


QUERIES = {
    f.__name__: f
    for f in (
        bm25_five_columns, search_end_to_end, search_newest_scan, search_without_query, search_rejections, pipeline_blend, rank_order_budget,
    )
}


def _tf(k: int, phrase: list[str]) -> str:
    return f"len(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(phrase) - 1}] = [{', '.join(repr(p) for p in phrase)}])) AS t{k}"


def _ranked(phrases: list[list[str]]) -> str:
    """Keyword ranks of all records; ``$`` between columns keeps phrases apart and isn't counted."""
    part = lambda c: f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"
    tokens = " || ['$'] || ".join([part("title"), part("content"), part("tenant_id"), part("project_id"), part("project_id")])
    idf = lambda k: f"greatest(ln((docs - d{k} + 0.5::DOUBLE) / (d{k} + 0.5::DOUBLE)), 0.000001::DOUBLE)"
    score = " + ".join(f"{idf(k)} * t{k} * 2.2::DOUBLE / (t{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))" for k in range(len(phrases)))
    return f"""tokens AS (
  SELECT memory_id, {tokens} AS w FROM memories
), tf AS (
  SELECT memory_id, len(list_filter(w, lambda x: x <> '$')) AS n, {', '.join(_tf(k, p) for k, p in enumerate(phrases))} FROM tokens
), totals AS (
  SELECT count(*) AS docs, avg(n) AS mean, {', '.join(f'count(*) FILTER (t{k} > 0) AS d{k}' for k in range(len(phrases)))} FROM tf
), ranked AS (
  SELECT memory_id, {score} AS bm FROM tf, totals WHERE {' + '.join(f't{k}' for k in range(len(phrases)))} > 0
)"""


def _search_sql(terms: list[str], scan: bool = False, vectors: bool = True) -> str:
    nearest = (
        "SELECT memory_id, updated_at, cosine FROM seen WHERE cosine IS NOT NULL ORDER BY updated_at DESC, memory_id LIMIT 300" if scan
        else "SELECT s.memory_id, s.updated_at, s.cosine FROM (SELECT * FROM whole WHERE cosine IS NOT NULL ORDER BY cosine DESC, memory_id LIMIT 500) n JOIN seen s USING (memory_id)"
    )
    cosine = "list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))" if vectors else "NULL::DOUBLE"
    matches = " + ".join(f"contains(h, '{t}')::INT" for t in terms) or "0"
    nothing = "matches = 0 AND retrieval <= 0" if terms else "false"
    keyword = f"{_ranked([[t] for t in terms])}, " if terms else ""
    fts = (
        "SELECT r.memory_id, bm / (1 + bm) AS fts FROM ranked r JOIN seen USING (memory_id) ORDER BY bm DESC, updated_at DESC, memory_id LIMIT 50" if terms
        else "SELECT memory_id, 0.0::DOUBLE AS fts FROM seen LIMIT 0"
    )
    newest = "" if terms or vectors else " UNION ALL (SELECT memory_id, 0.0::DOUBLE, 0.0::DOUBLE FROM seen ORDER BY updated_at DESC, memory_id LIMIT 50)"
    label = "'hybrid'" if terms and vectors else "'fts'" if terms else "'vector'" if vectors else "'recency_fallback'"
    return f"""WITH {RECORDS_SQL}, {keyword}whole AS (
  SELECT m.*, {cosine} AS cosine FROM memories m LEFT JOIN embeddings e ON e.vec_id = m.memory_id
), seen AS (
  SELECT * FROM whole WHERE tenant_id = 'en' AND project_id = 'src3'
), by_words AS ({fts}), near AS ({nearest}), by_vector AS (
  SELECT memory_id, cosine AS vec FROM near WHERE cosine > 0 ORDER BY cosine DESC, updated_at DESC, memory_id LIMIT 50
), candidates AS (
  SELECT memory_id, coalesce(fts, 0) AS fts, coalesce(vec, 0) AS vec FROM by_words FULL JOIN by_vector USING (memory_id){newest}
), own AS (
  SELECT s.*, c.fts, CASE WHEN vec > 0 THEN vec ELSE coalesce(cosine, 0) END AS vec,
         lower(title || '  ' || content || ' ' || tenant_id || ' ' || project_id || ' ' || project_id) AS h FROM candidates c JOIN whole s USING (memory_id)
), fused AS (
  SELECT *, CASE WHEN fts > 0 AND vec > 0 THEN 0.55::DOUBLE * fts + 0.45::DOUBLE * vec WHEN vec > 0 THEN vec ELSE fts END AS retrieval,
         {matches} AS matches, date_diff('day', updated_at, TIMESTAMP '2024-02-01') AS age FROM own
), scored AS (
  SELECT *, CASE WHEN {nothing} THEN 0.0::DOUBLE ELSE matches + 2.5::DOUBLE * greatest(retrieval, 0) + 0.6::DOUBLE + 0.35::DOUBLE
      + CASE status WHEN 'active' THEN 0.15::DOUBLE ELSE -0.2::DOUBLE END + least(importance, 1) * 0.25::DOUBLE
      + CASE WHEN age <= 1 THEN 0.3::DOUBLE WHEN age <= 7 THEN 0.15::DOUBLE WHEN age <= 30 THEN 0.05::DOUBLE ELSE 0::DOUBLE END END AS score,
    array_to_string(list_filter([CASE WHEN fts > 0 THEN 'fts match' END, CASE WHEN vec > 0 THEN 'vector similarity' END,
      CASE WHEN fts > 0 AND vec > 0 THEN 'hybrid retrieval' END, 'exact project scope', 'organization layer',
      CASE WHEN status = 'superseded' THEN 'superseded memory' END], lambda x: x IS NOT NULL), '; ') AS reasons, {label} AS strategy FROM fused
), found AS (
  SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, updated_at DESC, memory_id LIMIT 10
)"""


_SHOWN = " SELECT memory_id, round(fts, 4) AS fts, round(vec, 4) AS vec, round(score, 4) AS score, strategy, reasons FROM found"
_TERMS = ["and", "the", "tion"]

ORACLES = {
    "bm25_five_columns": f"WITH {RECORDS_SQL}, {_ranked([['don', 't'], ['src3'], ['the']])} SELECT memory_id, round(-bm, 6) AS rank FROM ranked ORDER BY rank, memory_id LIMIT 20",
    "search_end_to_end": _search_sql(_TERMS) + _SHOWN,
    "search_newest_scan": _search_sql(_TERMS, scan=True) + _SHOWN,
    "search_without_query": _search_sql([], vectors=False) + _SHOWN,
    "search_rejections": f"""WITH {RECORDS_SQL}, {_ranked([[t] for t in _TERMS])} SELECT memory_id,
  CASE WHEN memory_id % 3 = 0 THEN 'acl denied; ' ELSE '' END || 'missing tags: urgent' AS rejections
FROM ranked JOIN memories USING (memory_id) WHERE tenant_id = 'en' AND project_id = 'src3' ORDER BY bm DESC, updated_at DESC, memory_id LIMIT 50""",
    "pipeline_blend": _search_sql(_TERMS) + """, blend AS (
  SELECT *, 0.55::DOUBLE * score + 0.45::DOUBLE * coalesce(cosine, 0) AS combined FROM found
) SELECT memory_id, title, substr(content, 1, 200) AS excerpt, round(combined, 4) AS confidence FROM blend ORDER BY combined DESC, memory_id LIMIT 5""",
    "rank_order_budget": (_search_sql(_TERMS) + """, sized AS (
  SELECT memory_id, greatest(1, ceil(length(content) / 4.0))::BIGINT AS tokens, row_number() OVER (ORDER BY round(score, 4) DESC, memory_id) AS k FROM found
), fold(k, used, taken, memory_id, tokens) AS (
  SELECT 0::BIGINT, 0::BIGINT, false, NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT s.k, CASE WHEN f.used + s.tokens <= 600 THEN f.used + s.tokens ELSE f.used END, f.used + s.tokens <= 600, s.memory_id, s.tokens
  FROM fold f JOIN sized s ON s.k = f.k + 1
) SELECT memory_id, tokens FROM fold WHERE taken""").replace("WITH named", "WITH RECURSIVE named", 1),
}

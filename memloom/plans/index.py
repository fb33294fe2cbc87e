"""Queries: the stored keyword index, search with renewed holds, relations of what is found, preflight."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as X
from ..operators import keyword_index as K
from ..operators import lifecycle as C
from ..operators import search as S
from ..operators import triggers
from ..operators.ledger import saved
from ..sources.projections import AS_OF, RECORDS_SQL, records, table
from .knowledge import _BLANK
from .retrieval import EN_SRC3, QUERY, _query_vector
from .search import _TERMS, _ranked, _search_sql


def _folder(spark: SparkSession) -> str:
    saved(spark.range(1))  # names a checkpoint folder if none is
    return f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4()}"


def _built(spark: SparkSession, sf_dir: str, language: str | None = None) -> str:
    """The index of all records, in two batches: the first has every fifth in an old version and lacks every third."""
    root, rows = _folder(spark), records(spark, sf_dir)
    early = rows.where("memory_id % 3 <> 0")
    old = early.withColumn("content", F.when(F.col("memory_id") % 5 == 0, F.concat(F.lit("the "), F.reverse("content"))).otherwise(F.col("content")))
    K.add(old, S.indexed_text(old), root, 1, language)
    changed = early.where("memory_id % 5 = 0").select("memory_id")
    K.remove(changed, root, 2)
    late = rows.where("memory_id % 3 = 0 OR memory_id % 5 = 0")
    K.add(late, S.indexed_text(late), root, 2, language)
    return root


def keyword_index_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that has a term of the query, from the postings of its terms."""
    found = K.rank(spark, _built(spark, sf_dir), "Für the don't, src3")
    return found.select("memory_id", F.round("rank", 6).alias("rank"))


def text_cover_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that hold all stems of a query, by how close together they stand."""
    return K.cover_rank(spark, _built(spark, sf_dir, "english"), "the tioning of st and th").select("memory_id", F.round("rank", 6).alias("rank"))


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding")
    return saved(records(spark, sf_dir, with_status=True).join(vectors, "memory_id", "left"))


#: Records that a hold covers, and waiting deletions that take effect once no hold covers them.
HOLDS = (C.Hold("audit", scope={"project_id": "src3", "tenant_id": "en"}, until="2024-01-01"), C.Hold("litigation", ids=tuple(range(0, 100_000, 4))))


def _waiting(rows: DataFrame) -> DataFrame:
    was = F.when(F.col("memory_id") % 4 == 1, "deleted").when(F.col("memory_id") % 4 == 2, "active")
    return rows.withColumn("pre_hold_status", was).withColumn("status", F.when(was.isNotNull(), "held").otherwise(F.col("status")))


def search_after_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that renews the holds of its candidates: some deletions take effect, some records become held."""
    found = S.search(_waiting(_with_vectors(spark, sf_dir)), EN_SRC3, QUERY, _query_vector(spark, sf_dir), holds=HOLDS)
    return found.select("memory_id", "status", F.coalesce("pre_hold_status", F.lit("")).alias("was"), F.round("score", 4).alias("score"))


def search_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search from end to end with keyword ranks of the stored index."""
    ranked = K.rank(spark, _built(spark, sf_dir), QUERY)
    found = S.search(_with_vectors(spark, sf_dir), EN_SRC3, QUERY, _query_vector(spark, sf_dir), ranked=ranked)
    return found.select("memory_id", "strategy", F.round("score", 4).alias("score"))


def related_to_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search's records relate to: each record to the seventh and eleventh after it."""
    rows = _with_vectors(spark, sf_dir)
    found = S.search(rows, EN_SRC3, QUERY, _query_vector(spark, sf_dir))
    step = lambda k, name: rows.select(F.col("memory_id").alias("src"), (F.col("memory_id") + k).alias("dst"), F.lit(name).alias("relation"))
    valid = F.when(F.col("memory_id") % 6 == 0, F.col("updated_at"))
    others = rows.withColumns({"valid_to": valid, "status": F.when(F.col("memory_id") % 7 == 0, "deleted").otherwise(F.col("status"))})
    return S.related(others, step(7, "supports").unionByName(step(11, "related_to")), found, AS_OF, denied=F.col("memory_id") % 13 == 0)


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening turns of conversations against phrases of benchmark items."""
    words = F.split(T.collapsed(F.col("text")), " ")
    items = table(spark, sf_dir, "benchmark").withColumn("tenant_id", F.lit("all"))
    index = triggers.phrase_index(items.select("tenant_id", F.array_join(F.slice(words, 1, 2), " ").alias("phrase"), F.col("item_id").alias("memory_id")))
    rows = items.select(F.col("item_id").alias("memory_id"), F.lit("fact").alias("kind"), F.concat(F.lit("item "), "item_id").alias("title"), F.col("text").alias("content"),
                        ((F.col("item_id") % 10) / F.lit(10.0)).alias("importance"))
    turns = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", "turn", F.lit("all").alias("tenant_id"), F.concat(F.lit("p"), F.col("conv_id") % 3).alias("project_id"), "text")
    turns = turns.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("text"))).where("_k = 1").drop("_k")
    kept = spark.createDataFrame([("all", "p0", "Old."), ("all", "p1", "Kept.")], "tenant_id string, project_id string, summary string")
    kept = kept.withColumn("generated_at", F.lit(AS_OF).cast("timestamp_ntz") - F.when(F.col("project_id") == "p0", F.expr("INTERVAL '301' SECOND")).otherwise(F.expr("INTERVAL '300' SECOND")))
    return X.preflight(turns, rows, index, kept, AS_OF, "Answer from memory.", 160, ["conv_id", "turn"]).drop("turn")


QUERIES = {f.__name__: f for f in (keyword_index_rank, text_cover_rank, search_after_holds, search_by_index, related_to_found, preflight)}

#: Fixed for this text: the words whose stem is "tion" are it with endings that the rules drop.
_TION = "tion(ed|ing|ly|e|es|s|edly|ingly|lyed|lying)?"

_STATES = "CASE WHEN status = 'superseded' THEN -0.2::DOUBLE WHEN status = 'active' THEN 0.15::DOUBLE ELSE 0::DOUBLE END"


def _renewed_sql() -> str:
    """The search twice: over states as they were, then with those of the first candidates renewed."""
    plain = _search_sql(_TERMS).replace("CASE status WHEN 'active' THEN 0.15::DOUBLE ELSE -0.2::DOUBLE END", _STATES)
    waits = "CASE WHEN memory_id % 4 IN (1, 2) THEN 'held' ELSE status END"
    renewed = f"CASE WHEN memory_id NOT IN (SELECT memory_id FROM first) THEN {waits} WHEN memory_id % 4 = 0 THEN 'held' WHEN memory_id % 4 = 1 THEN 'deleted' WHEN memory_id % 4 = 2 THEN 'active' ELSE status END"
    was = "CASE WHEN memory_id NOT IN (SELECT memory_id FROM first) THEN CASE memory_id % 4 WHEN 1 THEN 'deleted' WHEN 2 THEN 'active' ELSE '' END WHEN memory_id % 4 = 0 THEN status ELSE '' END AS was"
    second = plain.replace("SELECT m.*, ", f"SELECT m.* REPLACE ({renewed} AS status), {was}, ").replace("AND project_id = 'src3'", "AND project_id = 'src3' AND status <> 'deleted'")
    first = plain.replace("SELECT m.*, ", f"SELECT m.* REPLACE ({waits} AS status), ")
    return f"WITH first AS ({first} SELECT memory_id FROM candidates), " + second.removeprefix("WITH ") + " SELECT memory_id, status, was, round(score, 4) AS score FROM found"


ORACLES = {
    "keyword_index_rank": f"WITH {RECORDS_SQL}, {_ranked([['don', 't'], ['fur'], ['src3'], ['the']])} SELECT memory_id, round(-bm, 6) AS rank FROM ranked",
    "text_cover_rank": rf"""WITH {RECORDS_SQL}, w AS (
  SELECT memory_id, regexp_extract_all(strip_accents(lower(concat_ws(chr(10) || '$' || chr(10), title, content, tenant_id || chr(10) || project_id, project_id))), '[\p{{L}}\p{{N}}]+|\$') AS w,
         regexp_extract_all(strip_accents(lower(concat_ws(' ', title, content, tenant_id, project_id, project_id))), '[\p{{L}}\p{{N}}]+') AS v FROM memories WHERE NOT contains(content, '$')
  UNION ALL
  SELECT memory_id, regexp_extract_all(strip_accents(lower(concat_ws(chr(10) || chr(1) || chr(10), title, content, tenant_id || chr(10) || project_id, project_id))), '[\p{{L}}\p{{N}}]+|' || chr(1)) AS w, [] FROM memories WHERE contains(content, '$')
), e AS (SELECT memory_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM w), q AS (
  SELECT memory_id, p, CASE WHEN t IN ('st', 'th') THEN t ELSE 'tion' END AS t, row_number() OVER (PARTITION BY memory_id ORDER BY p) AS i FROM e WHERE t IN ('st', 'th') OR regexp_full_match(t, '{_TION}')
), l AS (
  SELECT *, max(p) FILTER (t = 'st') OVER u AS a, max(p) FILTER (t = 'th') OVER u AS b, max(p) FILTER (t = 'tion') OVER u AS c FROM q WINDOW u AS (PARTITION BY memory_id ORDER BY p)
), f AS (SELECT *, least(a, b, c) AS s FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
g AS (SELECT memory_id, s, min(p) AS p, min(i) AS i FROM f GROUP BY 1, 2)
SELECT g.memory_id, round(sum(0.1::DOUBLE / (1 + (g.p - g.s) - (g.i - q.i))), 6) AS rank FROM g JOIN q ON q.memory_id = g.memory_id AND q.p = g.s GROUP BY 1""",
    "search_after_holds": _renewed_sql(),
    "search_by_index": _search_sql(_TERMS) + " SELECT memory_id, strategy, round(score, 4) AS score FROM found",
    "related_to_found": _search_sql(_TERMS) + """, r AS (SELECT memory_id AS src, memory_id + 7 AS dst, 'supports' AS relation FROM memories UNION ALL SELECT memory_id, memory_id + 11, 'related_to' FROM memories),
b AS (SELECT src AS memory_id, relation, dst AS other FROM r UNION ALL SELECT dst, relation, src FROM r)
SELECT b.memory_id, relation, other FROM b JOIN found USING (memory_id) JOIN memories m ON m.memory_id = other
WHERE other % 7 <> 0 AND other % 13 <> 0 AND NOT (other % 6 = 0 AND m.updated_at < TIMESTAMP '2024-02-01')""",
    "preflight": rf"""WITH p AS (
  SELECT DISTINCT array_to_string(string_split(trim(regexp_replace(lower(text), {_BLANK}, ' ', 'g')), ' ')[1:2], ' ') AS phrase, item_id FROM benchmark
), m AS (
  SELECT conv_id, text, 'p' || conv_id % 3 AS project_id, greatest(0, 160 - 4 - ceil(len(list_filter(string_split_regex(text, {_BLANK}), lambda x: x <> '')) * 1.3::DOUBLE)::BIGINT) AS room
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY text) AS k FROM conversations WHERE turn = 0) WHERE k = 1
), w AS (
  SELECT conv_id, list_filter(string_split(trim(regexp_replace(lower(text), {_BLANK}, ' ', 'g')), ' '), lambda x: x <> '') AS w FROM m
), g AS (
  SELECT conv_id, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS gram FROM w
), d AS (SELECT DISTINCT gram FROM g), h AS (
  SELECT gram, item_id, CASE WHEN gram = phrase THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS score FROM d JOIN p ON contains(gram, phrase) OR contains(phrase, gram) WHERE phrase <> '' AND gram <> ''
), c AS (SELECT conv_id, item_id, max(score) AS score FROM g JOIN h USING (gram) GROUP BY 1, 2), v AS (
  SELECT conv_id, c.item_id, score, ceil(len(list_filter(string_split_regex(text, {_BLANK}), lambda x: x <> '')) * 1.3::DOUBLE)::BIGINT AS tokens, text,
         round(0.6::DOUBLE * score + 0.4::DOUBLE * ((c.item_id % 10) / 10.0::DOUBLE), 9) AS v FROM c JOIN benchmark b ON b.item_id = c.item_id
), l AS (
  SELECT conv_id, list({{'id': item_id, 'tokens': tokens, 'line': '] (fact, score=' || printf('%.2f', score) || ') item ' || item_id || chr(10) || text}} ORDER BY v DESC, item_id::VARCHAR) AS items, count(*) AS called FROM v GROUP BY 1
), f AS (
  SELECT m.*, coalesce(called, 0) AS called, coalesce(list_reduce(items, lambda a, x: CASE WHEN a.used + x.tokens <= room THEN {{'used': a.used + x.tokens, 'items': list_append(a.items, x)}} ELSE a END,
    {{'used': 0::BIGINT, 'items': []::STRUCT(id BIGINT, tokens BIGINT, line VARCHAR)[]}}), {{'used': 0::BIGINT, 'items': []::STRUCT(id BIGINT, tokens BIGINT, line VARCHAR)[]}}) AS t FROM m LEFT JOIN l USING (conv_id)
), s AS (SELECT *, CASE project_id WHEN 'p1' THEN 'Kept.' ELSE 'No overview yet.' END AS summary FROM f)
SELECT conv_id, called, summary, array_to_string(list_transform(t.items, lambda x: x.id), ',') AS selected, t.used AS used, room - t.used AS remaining,
  '<system>' || chr(10) || 'Answer from memory.' || chr(10) || '</system>' || chr(10) || chr(10) || '<overview>' || chr(10) || summary || chr(10) || '</overview>' || chr(10) || chr(10) || '<memories>'
  || array_to_string(list_transform(t.items, lambda x, i: chr(10) || '[#' || i || x.line), '') || chr(10) || '</memories>' || chr(10) || chr(10) || '<user>' || chr(10) || text || chr(10) || '</user>' AS prompt FROM s""",
}

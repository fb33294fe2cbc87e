"""Queries: upkeep of projections, and the column functions and small joins over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access as A
from ..operators import capture as C
from ..operators import evaluate as E
from ..operators import extraction as N
from ..operators import filters as L
from ..operators import ledger as G
from ..operators import lifecycle as Y
from ..operators import records as D
from ..operators import retrieval as R
from ..operators import upkeep as U
from ..sources.projections import AS_OF, RECORDS_SQL, records, table

PATH = "concat_ws('/', 'src', source, lang, concat(doc_id, '.md'))"


def path_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"))
    return docs.where(L.under_path(F.col("path"), "src/src3/en"))


def generic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose metadata doesn't make them procedures; a key with a JSON null counts as present."""
    from ..operators.search import is_procedure

    meta = F.when(F.col("doc_id") % 4 == 0, '{"projection":"repo-ledger","event":{"structured_data":{"procedure":null}}}').when(
        F.col("doc_id") % 4 == 1, '{"projection":"other","event":{"structured_data":{"procedure":{}}}}'
    ).when(F.col("doc_id") % 4 == 2, '{"projection":"repo-ledger","event":{"structured_data":{"note":1}}}')
    return table(spark, sf_dir, "documents").where(~is_procedure(meta)).select("doc_id")


def write_time_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.col("text").alias("content")
    )
    return N.conflicting(said.where("turn = 0"), said.where("turn > 0"), "conv_id")


def inferred_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, k: F.when(F.col(c) % k == 0, F.col(c).cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", R.inferred_layer(at("o_orderkey", 5), at("o_custkey", 3), at("o_custkey", 2)).alias("layer")
    )


def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    uri = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc://"), key))
    return table(spark, sf_dir, "documents").select("doc_id", R.citation(F.lit("document"), key, title, uri).alias("label"))


def created_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = records(spark, sf_dir).select("memory_id", F.col("updated_at").alias("created_at"), T.fingerprint(T.collapsed(F.col("content"))).alias("fingerprint"))
    return Y.created(named.where("memory_id % 5 = 0"), named.where("memory_id % 5 <> 0")).select("memory_id", "created_at")


def patched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = records(spark, sf_dir).select("memory_id", "title", "project_id")
    fields = F.when(F.col("memory_id") % 8 == 0, F.array(F.lit("title"), F.lit("project_id"))).otherwise(F.array(F.lit("title")))
    changes = now.where("memory_id % 4 = 0").select("memory_id", F.lit("new").alias("title"), F.lit(None).cast("string").alias("project_id"), fields.alias("set"))
    return Y.patched(now, changes)


def superseded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, with_status=True).select("memory_id", "tenant_id", "status")
    changes = rows.where("memory_id % 3 = 0").select("memory_id", (F.col("memory_id") - 1).alias("supersedes"))
    return D.superseded(rows, changes, rows.where("memory_id % 7 = 0").select("memory_id"))


def merged_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("o_orderstatus") == "F", "retracted").when(F.col("o_orderstatus") == "P", "superseded").otherwise("active")
    new = F.when(F.col("o_orderpriority") == "1-URGENT", "retracted").when(F.col("o_orderpriority") == "2-HIGH", "superseded").otherwise("active")
    return table(spark, sf_dir, "orders").select("o_orderkey", G.merged_status(known, new).alias("status"))


def pronoun_rewriting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("I said that me and my friend, I'm sure, I've heard: "), "text").alias("s"))
    return said.select("conv_id", "turn", T.pronouns_rewritten(F.col("s"), "the user", "their").alias("told"))


ROLES = "CASE c_mktsegment WHEN 'BUILDING' THEN 'viewer' WHEN 'MACHINERY' THEN 'editor' WHEN 'HOUSEHOLD' THEN 'admin' ELSE 'guest' END"


def role_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select("c_custkey", F.expr(ROLES).alias("role"))
    return A.role_permissions(users).select("c_custkey", F.array_join("permissions", ",").alias("permissions"))


def cold_start_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "documents").select(
        "doc_id", F.array("source", "lang").alias("expected_entities"), F.array("source").alias("entities"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("d"))).otherwise(F.array().cast("array<string>")).alias("expected_decisions"),
        F.array().cast("array<string>").alias("decisions"), F.col("text").alias("summary"), F.array(F.lit("the"), F.lit("AND"), F.lit("zz")).alias("summary_terms"),
    )
    scored = E.cold_start(cases)
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("entity_recall", "decision_recall", "summary_quality")])


def cached_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    kept = rows.select("tenant_id", "project_id", F.col("title").alias("summary"), (F.col("updated_at") - F.make_dt_interval(secs=F.col("memory_id") / 1000)).alias("generated_at"))
    return D.overview_or_default(rows.select("tenant_id", "project_id").distinct(), kept, AS_OF, 86_400)


def relations_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("memory_id", "tenant_id")
    made = lambda k: rows.select(F.col("memory_id").alias("src"), (F.col("memory_id") + k).alias("dst"), F.lit("related").alias("relation"))
    return D.related_once(made(1).union(made(2)).union(made(1)), rows)


def capture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    calls = events.select(
        F.lit("local").alias("provider"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("call_id"), F.col("event_type").alias("tool"),
        F.col("event_id").alias("ordinal"), status.alias("status"), F.create_map(F.lit("path"), F.lit("a"), F.lit("secret"), F.lit("b")).alias("arguments"),
    )
    return C.summary(C.observations(calls.union(calls.where("ordinal % 2 = 0"))))


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("scope"))
    kind = F.when(F.col("id") % 11 == 0, None).otherwise(F.col("kind"))
    actual = rows.where("id % 7 <> 0").select((F.when(F.col("id") % 13 == 0, -F.col("id")).otherwise(F.col("id"))).alias("id"), F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("title")).alias("title"), kind.alias("kind"), "scope")
    return rows, actual


def drift_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = U.drifted(*_customers(spark, sf_dir), "id", ["title", "kind", "scope"])
    return found.select("id", "action", F.array_join("changed", ",").alias("changed"))


def drift_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the repair the projection is what the ledger says."""
    return U.repaired(*_customers(spark, sf_dir), "id", ["title", "kind", "scope"])


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, [*U.ISSUE_KINDS, "other"])), (F.col("o_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(kind.alias("kind"), F.col("o_custkey").alias("c")).agg(
        F.collect_list(F.col("o_orderkey").cast("string")).alias("memory_ids"), F.collect_set("o_orderpriority").alias("paths")
    )


def maintenance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = U.maintenance_plan(_issues(spark, sf_dir), 40)
    return plan.select("place", "kind", F.array_join("memory_ids", ",").alias("memory_ids"), "ids_omitted", F.array_join("paths", ",").alias("paths"), "paths_omitted")


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issues(spark, sf_dir)
    return U.issue_counts(issues, U.maintenance_plan(issues, 40))


def procedure_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as procedures: their name is the title, their type the goal, their brand a trigger."""
    part = table(spark, sf_dir, "part")
    procedures = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("goal"), F.array(F.lower("p_brand")).alias("triggers"),
        F.array("p_brand").alias("applies_to"), (F.col("p_size") / 50.0).alias("importance"),
    )
    states = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "ready").otherwise("unverified").alias("state"), F.lit(0.5).alias("prior"))
    found = U.recalled_procedures(procedures, states, "large polished box steel", ids=[3], paths=["Brand#12"])
    return found.select("id", F.round("relevance", 6).alias("relevance"), "state", F.round("prior", 6).alias("prior"))


def receipt_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    procedures = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 9 != 0).alias("approved"), F.lit("1995-01-01").cast("timestamp_ntz").alias("created_at")
    )
    outcomes = orders.select(
        F.col("o_orderkey").alias("outcome_id"), F.col("o_custkey").alias("procedure_id"), (F.col("o_orderkey") % 1000).alias("receipt_id"),
        F.col("o_orderkey").alias("episode_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )
    return U.receipt_errors(outcomes, procedures).select("outcome_id", F.array_join("errors", "; ").alias("errors"))


def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc://"), "doc_id")).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit('{"type":"document","id":"'), "doc_id", F.lit('","title":"t"}'))
    ).otherwise(F.lit('{"title":"no type"}'))
    rows = table(spark, sf_dir, "documents").select("doc_id", U.source_reference(given).alias("s")).where("s IS NOT NULL")
    return rows.select("doc_id", "s.type", "s.id", "s.title", "s.uri")


QUERIES = {
    f.__name__: f
    for f in (
        path_prefix_filter, generic_records, write_time_conflicts, inferred_layers, citation_labels, created_records, patched_records,
        superseded_records, merged_statuses, pronoun_rewriting, role_rights, cold_start_recall, cached_overviews, relations_once,
        capture_summary, drift_repair, drift_repaired, maintenance_plan, issue_counts, procedure_recall, receipt_errors, source_references,
    )
}

_WORDS = r"list_distinct(list_filter(list_transform(list_filter(string_split_regex(lower(text), '[ \t\n\f\r]+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[.,!?;:\"()\[\]{}]+|[.,!?;:\"()\[\]{}]+$', '', 'g')), lambda w: w <> ''))"
_NO = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.NEGATIONS) + "]"
_ISSUES = f"""issues AS (
  SELECT [{', '.join(repr(k) for k in U.ISSUE_KINDS)}, 'other'][o_custkey % 6 + 1] AS kind, list_sort(list(o_orderkey::VARCHAR)) AS ids, list_sort(list(DISTINCT o_orderpriority)) AS paths
  FROM orders GROUP BY o_custkey
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY list_position([{', '.join(repr(k) for k in U.ISSUE_KINDS)}], kind), sha256(kind || '|' || array_to_string(ids, ',') || '|' || array_to_string(paths, ','))) AS place
  FROM issues WHERE kind <> 'other'
)"""

ORACLES = {
    "path_prefix_filter": f"SELECT doc_id, path FROM (SELECT doc_id, {PATH} AS path FROM documents) WHERE starts_with(path, 'src/src3/en/')",
    "generic_records": "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0",
    "write_time_conflicts": f"""WITH w AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, {_WORDS} AS t FROM conversations)
SELECT a.id AS memory_id, b.id AS candidate_id FROM w a JOIN w b USING (conv_id)
WHERE a.turn = 0 AND b.turn > 0 AND list_has_any(a.t, {_NO}) <> list_has_any(b.t, {_NO}) AND len(list_filter(list_intersect(a.t, b.t), lambda x: NOT list_contains({_NO}, x))) > 0""",
    "inferred_layers": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'session' WHEN o_custkey % 3 = 0 AND o_custkey % 2 <> 0 THEN 'agent'
WHEN o_custkey % 2 = 0 THEN 'user' ELSE 'organization' END AS layer FROM orders""",
    "citation_labels": """SELECT doc_id, 'document:' || doc_id || CASE WHEN doc_id % 2 = 0 AND source IS NOT NULL THEN ' (' || source || ')' ELSE '' END
|| CASE WHEN doc_id % 3 = 0 THEN ' <doc://' || doc_id || '>' ELSE '' END AS label FROM documents""",
    "created_records": f"""WITH {RECORDS_SQL}, first AS (
  SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY updated_at, memory_id) AS k FROM memories WHERE memory_id % 5 <> 0
) SELECT memory_id, updated_at AS created_at FROM first WHERE k = 1 AND fingerprint NOT IN (SELECT fingerprint FROM memories WHERE memory_id % 5 = 0)""",
    "patched_records": f"""WITH {RECORDS_SQL} SELECT memory_id, CASE WHEN memory_id % 4 = 0 THEN 'new' ELSE title END AS title,
CASE WHEN memory_id % 8 = 0 THEN NULL ELSE project_id END AS project_id FROM memories""",
    "superseded_records": f"""WITH {RECORDS_SQL} SELECT m.memory_id, m.tenant_id, CASE WHEN m.status = 'active' AND m.memory_id % 7 <> 0 AND n.memory_id IS NOT NULL THEN 'superseded' ELSE m.status END AS status
FROM memories m LEFT JOIN memories n ON n.memory_id = m.memory_id + 1 AND n.memory_id % 3 = 0 AND n.status = 'active' AND n.tenant_id = m.tenant_id""",
    "merged_statuses": """SELECT o_orderkey, ['active', 'superseded', 'retracted'][1 + greatest(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END,
CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END)] AS status FROM orders""",
    "pronoun_rewriting": r"""WITH s AS (SELECT conv_id, turn, 'I said that me and my friend, I''m sure, I''ve heard: ' || text AS s FROM conversations),
a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)\bI''m\b', 'the user is', 'g'), '(?i)\bI''ve\b', 'the user has', 'g'), '(?i)\bI''ll\b', 'the user will', 'g'), '(?i)\bI''d\b', 'the user would', 'g') AS s FROM s),
b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(s, '\bI\b', 'the user', 'g'), '(?i)\bmy\b', 'their', 'g'), '(?i)\bme\b', 'the user', 'g') AS s FROM a)
SELECT conv_id, turn, upper(substr(s, 1, 1)) || substr(s, 2) AS told FROM b""",
    "role_rights": f"SELECT c_custkey, CASE {ROLES} WHEN 'viewer' THEN 'read' WHEN 'editor' THEN 'read,write' WHEN 'admin' THEN 'read,write,delete,admin' ELSE '' END AS permissions FROM customer",
    "cold_start_recall": """SELECT doc_id, CASE WHEN lang = source THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS entity_recall, CASE WHEN doc_id % 2 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS decision_recall,
CASE WHEN f > 0.5 THEN 1.0::DOUBLE ELSE round(f, 6) END AS summary_quality
FROM (SELECT *, (contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT + contains(lower(text), 'zz')::INT) / 3.0::DOUBLE AS f FROM documents)""",
    "cached_overviews": f"""WITH {RECORDS_SQL}, kept AS (
  SELECT *, updated_at - to_milliseconds(memory_id) AS generated_at FROM memories
), fresh AS (
  SELECT tenant_id, project_id, arg_max(title, generated_at) AS summary FROM kept WHERE generated_at >= TIMESTAMP '2024-01-31' GROUP BY 1, 2
) SELECT tenant_id, project_id, coalesce(summary, 'No overview yet.') AS summary FROM (SELECT DISTINCT tenant_id, project_id FROM memories) LEFT JOIN fresh USING (tenant_id, project_id)""",
    "relations_once": """SELECT a.doc_id AS src, b.doc_id AS dst, 'related' AS relation FROM documents a JOIN documents b ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2) AND a.lang = b.lang""",
    "capture_summary": """SELECT 'local' AS provider, user_id::VARCHAR AS session_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok,
count(*) FILTER (event_type = 'error') AS n_error, count(*) AS n_redacted FROM events GROUP BY user_id""",
    "drift_repair": """WITH a AS (
  SELECT CASE WHEN c_custkey % 13 = 0 THEN -c_custkey ELSE c_custkey END AS id, CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE c_name END AS title,
         CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 11 = 0 OR c_custkey % 13 = 0 AND c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS kind FROM customer WHERE c_custkey % 7 <> 0
), both_sides AS (
  SELECT coalesce(c_custkey, id) AS id, c_custkey IS NOT NULL AS e, a.id IS NOT NULL AS x, c_name IS DISTINCT FROM title AS t, c_mktsegment IS DISTINCT FROM kind AS k FROM customer FULL JOIN a ON a.id = c_custkey
) SELECT id, CASE WHEN NOT x THEN 'insert' WHEN NOT e THEN 'remove' ELSE 'rewrite' END AS action,
  CASE WHEN e AND x THEN concat_ws(',', CASE WHEN t THEN 'title' END, CASE WHEN k THEN 'kind' END) ELSE '' END AS changed FROM both_sides WHERE NOT e OR NOT x OR t OR k""",
    "drift_repaired": "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS kind, c_nationkey AS scope FROM customer",
    "maintenance_plan": f"""WITH {_ISSUES} SELECT place, kind, array_to_string(ids[1:32], ',') AS memory_ids, greatest(len(ids) - 32, 0) AS ids_omitted,
array_to_string(paths[1:32], ',') AS paths, greatest(len(paths) - 32, 0) AS paths_omitted FROM ordered WHERE place <= 40""",
    "issue_counts": f"""WITH {_ISSUES} SELECT kind, count(*) AS total, count(*) FILTER (place <= 40) AS emitted, count(*) FILTER (place > 40) AS omitted FROM ordered GROUP BY kind""",
    "procedure_recall": r"""WITH p AS (
  SELECT p_partkey AS id, p_size, p_partkey = 3 OR p_brand = 'Brand#12' AS exact,
         len(list_intersect(list_distinct(string_split_regex(lower(p_name || ' ' || p_type || ' ' || p_brand), '[ \t\n\f\r]+')), ['box', 'large', 'polished', 'steel'])) AS m FROM part
) SELECT id, CASE WHEN exact THEN 2.0::DOUBLE ELSE m / 4.0::DOUBLE END AS relevance, CASE WHEN p_size > 25 THEN 'ready' ELSE 'unverified' END AS state,
  round(0.5::DOUBLE + p_size / 50.0::DOUBLE * 0.01::DOUBLE, 6) AS prior FROM p WHERE exact OR m >= 2""",
    "receipt_errors": """WITH o AS (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey % 1000 ORDER BY o_orderdate, o_orderkey) AS k FROM orders
), e AS (
  SELECT o_orderkey AS outcome_id, concat_ws('; ', CASE WHEN c_custkey IS NULL OR o_custkey % 9 = 0 THEN 'no approved version' END,
         CASE WHEN c_custkey IS NOT NULL AND o_orderdate < TIMESTAMP '1995-01-01' THEN 'predates its version' END, CASE WHEN k > 1 THEN 'duplicate receipt' END) AS errors
  FROM o LEFT JOIN customer ON c_custkey = o_custkey
) SELECT * FROM e WHERE errors <> ''""",
    "source_references": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'uri' ELSE 'document' END AS type, CASE WHEN doc_id % 3 = 0 THEN 'doc://' || doc_id ELSE doc_id::VARCHAR END AS id,
CASE WHEN doc_id % 3 = 1 THEN 't' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'doc://' || doc_id END AS uri FROM documents WHERE doc_id % 3 <> 2""",
}

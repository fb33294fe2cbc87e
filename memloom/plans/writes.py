"""Queries: guarded writes, nested records, onboarding, statistics, feedback and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as Q
from ..operators import writes as W
from ..operators.ledger import saved
from ..sources.projections import RECORDS_SQL, place_graph, records, table
from . import knowledge


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as connector sources: their keys in a small range, customers' halves as tenants."""
    at = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((at % 3000).alias("source_id"), F.concat(F.lit("t"), at % 2000 % 7).alias("tenant_id"), F.col("o_orderstatus").alias("state"), F.concat("o_orderdate", F.lit("/"), at).alias("version"))


def guarded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources merged by tenants: what is kept, and which changes were refused."""
    rows = _sources(spark, sf_dir)
    now = rows.where("source_id % 3 = 0").groupBy("source_id").agg(F.max_by(F.struct("tenant_id", "state"), "version").alias("r"), F.max("version").alias("version"))
    now = now.select("source_id", "r.tenant_id", "r.state", "version")
    merged, refused = W.guarded_upsert(now, rows, ["source_id"], "version")
    left = merged.select("source_id", "tenant_id", "state", F.lit("kept").alias("what"), F.lit(1).cast("long").alias("n"))
    return left.unionByName(refused.groupBy("source_id").agg(F.count("*").alias("n")).select("source_id", F.lit("").alias("tenant_id"), F.lit("").alias("state"), F.lit("refused").alias("what"), "n"))


def erase_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(W.erase_selector("en", project_id="src3")).select("memory_id")


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pages as their sources and words of benchmark items as phrases."""
    rows = records(spark, sf_dir).select("memory_id")
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 300).alias("memory_id"), (-F.col("page_id")).alias("place"), F.lit("page").alias("source_type"), F.col("page_id").cast("string").alias("source_id"))
    items = table(spark, sf_dir, "benchmark")
    phrases = items.select((F.col("item_id") % 50).alias("memory_id"), F.concat(F.lit("p"), F.col("item_id") % 4).alias("phrase"))
    found = W.nested_records(rows, pages, phrases)
    shown = F.array_join(F.transform("source_references", lambda s: F.concat_ws(":", s["source_type"], s["source_id"])), " ")
    return found.select("memory_id", shown.alias("sources"), F.array_join("trigger_phrases", " ").alias("phrases"))


def onboarding_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tenants: customers as connectors, suppliers as sources, orders as grants."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"))
    count = lambda t, k, name, most: table(spark, sf_dir, t).groupBy(F.col(k).alias("tenant_id")).agg(F.greatest(F.count("*") - most, F.lit(0)).alias(name))
    rows = nation
    for part in (count("customer", "c_nationkey", "connectors", 55), count("supplier", "s_nationkey", "sources", 3), count("customer", "c_nationkey", "principals", 50), count("supplier", "s_nationkey", "grants", 2)):
        rows = rows.join(part, "tenant_id", "left")
    rows = rows.fillna(0).withColumn("history", F.col("tenant_id") % 2)
    return W.onboarding(rows)


def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = place_graph(spark, sf_dir)
    ids = saved(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    nodes = ids.withColumn("type", F.regexp_extract("id", "^[a-z]+", 0))
    ranks = Q.pagerank(ids, edges, 20).select("id", F.round("rank", 6).alias("rank"))
    return W.graph_statistics(nodes, ranks, Q.degree_centrality(ids, edges).withColumn("centrality", F.round("centrality", 9)))


def ordered_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("line"))
    return W.ordered_fingerprint(rows, ["o_custkey"], "o_orderkey", "line")


def feedback_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback of several tenants: history of what was taken, and how many rows each log gets."""
    rows = records(spark, sf_dir).withColumn("status", F.when(F.col("memory_id") % 11 == 0, "deleted").otherwise("active"))
    labels = table(spark, sf_dir, "labels")
    kind = F.when(F.col("quality") == 1, "positive").when(F.col("toxic") == 1, "negative").otherwise("correction")
    asked = labels.select("doc_id", kind.alias("kind"), F.explode(F.array(*map(F.lit, range(3)))).alias("k")).select(
        (F.col("doc_id") * 2 + F.floor(F.col("k") / 2)).alias("feedback_id"), F.col("doc_id").alias("memory_id"), F.element_at(F.array(*map(F.lit, ("en", "de", "en"))), F.col("k") + 1).alias("tenant_id"),
        "kind", F.lit("").alias("comment"), F.lit("a").alias("actor_id"), F.col("k").alias("at"),
    )
    good, history, audit = W.feedback_added(rows, asked)
    shown = history.select("memory_id", "old_memory", "new_memory", "details")
    counts = good.agg(F.count("*").alias("n")).unionAll(audit.agg(F.count("*")))
    return shown.unionByName(counts.select(F.lit(-1).cast("long").alias("memory_id"), F.col("n").cast("string").alias("old_memory"), F.lit("").alias("new_memory"), F.lit("").alias("details")))


def live_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as memories of commands, orders' priorities as what the repository declares."""
    key = F.col("c_custkey")
    found = table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"), F.when(key % 4 == 0, "command").otherwise("memory").alias("type"), F.col("c_mktsegment").alias("command"), F.concat(F.lit("d"), key % 6).alias("cwd")
    )
    commands = table(spark, sf_dir, "supplier").select(F.element_at(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), (F.col("s_suppkey") % 2 + 1).cast("int")).alias("command"), F.concat(F.lit("d"), F.col("s_suppkey") % 3).alias("cwd"))
    return W.without_live_commands(found, commands, found.where("CAST(id AS INT) % 10 = 0").select("id")).select("id", "type")


def phrase_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of documents as they should be indexed, against an index with some lost, renamed and of another tenant."""
    rows = records(spark, sf_dir).select("memory_id", "tenant_id", F.explode(F.array(F.col("project_id"), F.concat(F.lit("p"), F.col("memory_id") % 5))).alias("phrase"))
    at = F.col("memory_id")
    there = rows.where("NOT (memory_id % 20 = 0 AND phrase LIKE 'p%')").withColumns({
        "tenant_id": F.when(at % 30 == 7, "xx").otherwise(F.col("tenant_id")), "phrase": F.when((at % 25 == 3) & F.col("phrase").startswith("src"), "old").otherwise(F.col("phrase")),
    })
    shown = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws("@", x["phrase"], x["tenant_id"])), " "), F.lit("")).alias(c)
    return W.phrase_drift(rows, there).select("memory_id", shown("wanted"), shown("found"))


QUERIES = {
    f.__name__: f
    for f in (guarded_sources, erase_selected, nested_records, onboarding_steps, graph_statistics, ordered_fingerprints, feedback_written, live_commands, phrase_drift)
}

ORACLES = {
    "guarded_sources": """WITH r AS (SELECT o_orderkey % 3000 AS s, 't' || o_orderkey % 2000 % 7 AS t, o_orderstatus AS st, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '/' || o_orderkey AS v FROM orders),
o AS (SELECT s, CASE WHEN s % 3 = 0 THEN arg_max(t, v) ELSE arg_min(t, (v, t)) END AS owner FROM r GROUP BY 1), j AS (SELECT r.*, t <> owner AS foreign_ FROM r JOIN o USING (s))
SELECT s AS source_id, any_value(t) AS tenant_id, arg_max(st, v) AS state, 'kept' AS what, 1 AS n FROM j WHERE NOT foreign_ GROUP BY 1
UNION ALL SELECT s, '', '', 'refused', count(*) FROM j WHERE foreign_ GROUP BY 1""",
    "erase_selected": f"WITH {RECORDS_SQL} SELECT memory_id FROM memories WHERE tenant_id = 'en' AND project_id = 'src3'",
    "nested_records": """SELECT doc_id AS memory_id, coalesce((SELECT string_agg('page:' || page_id, ' ' ORDER BY page_id DESC) FROM pages WHERE page_id % 300 = doc_id), '') AS sources,
  coalesce((SELECT string_agg(DISTINCT 'p' || item_id % 4, ' ' ORDER BY 'p' || item_id % 4) FROM benchmark WHERE item_id % 50 = doc_id), '') AS phrases FROM documents""",
    "onboarding_steps": """WITH c AS (SELECT n_nationkey AS t, (SELECT greatest(count(*) - 55, 0) FROM customer WHERE c_nationkey = n_nationkey) AS a, (SELECT greatest(count(*) - 3, 0) FROM supplier WHERE s_nationkey = n_nationkey) AS b,
  (SELECT greatest(count(*) - 50, 0) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT greatest(count(*) - 2, 0) FROM supplier WHERE s_nationkey = n_nationkey) AS d FROM nation)
SELECT t AS tenant_id, unnest(['storage', 'hot_cache', 'connector_registry', 'source_inventory', 'principal_mapping', 'source_permissions', 'memory_lifecycle', 'benchmark_proof']) AS step,
  unnest(['complete', 'warning', CASE WHEN a > 0 THEN 'complete' ELSE 'pending' END, CASE WHEN b > 0 THEN 'complete' ELSE 'pending' END, CASE WHEN c > 0 THEN 'complete' ELSE 'pending' END, CASE WHEN d > 0 THEN 'complete' ELSE 'pending' END,
    CASE WHEN t % 2 > 0 THEN 'complete' ELSE 'pending' END, 'complete']) AS status, a > 0 AND b > 0 AND c > 0 AND d > 0 AS ready FROM c""",
    "graph_statistics": f"""WITH r AS ({knowledge.ORACLES['pagerank_20']}), d AS ({knowledge.ORACLES['degree_centrality']})
SELECT 'nodes' AS part, regexp_extract(id, '^[a-z]+') AS name, count(*)::DOUBLE AS value FROM d GROUP BY 2
UNION ALL (SELECT 'top', r.id, rank FROM r JOIN d ON d.id = r.id ORDER BY rank DESC, centrality DESC, r.id LIMIT 15)""",
    "ordered_fingerprints": "SELECT o_custkey, sha256(string_agg(o_orderstatus || '|' || o_orderpriority || chr(10), '' ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY 1",
    "feedback_written": f"""WITH {RECORDS_SQL}, l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' ELSE 'correction' END AS kind, unnest([0, 1, 2]) AS k FROM labels),
a AS (SELECT doc_id * 2 + k // 2 AS f, doc_id AS m, ['en', 'de', 'en'][k + 1] AS t, kind, k FROM l), g AS (
  SELECT a.*, row_number() OVER (PARTITION BY f ORDER BY k, m) AS i FROM a JOIN memories ON memory_id = m AND tenant_id = t WHERE m % 11 <> 0
), p AS (SELECT *, CASE kind WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS p FROM g WHERE i = 1), s AS (SELECT *, sum(p) OVER (PARTITION BY m ORDER BY k, f) AS n FROM p)
SELECT m AS memory_id, '{{"memory_id":' || m || ',"net_score":' || (n - p) || '}}' AS old_memory, '{{"memory_id":' || m || ',"net_score":' || n || '}}' AS new_memory, '{{"feedback_id":' || f || ',"kind":"' || kind || '"}}' AS details FROM s
UNION ALL SELECT -1, count(*)::VARCHAR, '', '' FROM s UNION ALL SELECT -1, count(*)::VARCHAR, '', '' FROM s""",
    "live_commands": """SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 = 0 THEN 'command' ELSE 'memory' END AS type FROM customer
WHERE c_custkey % 4 = 0 OR c_custkey % 10 = 0 OR (c_mktsegment, 'd' || c_custkey % 6) NOT IN (SELECT (['BUILDING', 'MACHINERY'][s_suppkey % 2 + 1], 'd' || s_suppkey % 3) FROM supplier)""",
    "phrase_drift": f"""WITH {RECORDS_SQL}, w AS (SELECT memory_id AS m, tenant_id AS t, unnest([project_id, 'p' || memory_id % 5]) AS p FROM memories),
f AS (SELECT m, CASE WHEN m % 30 = 7 THEN 'xx' ELSE t END AS t, CASE WHEN m % 25 = 3 AND p LIKE 'src%' THEN 'old' ELSE p END AS p FROM w WHERE NOT (m % 20 = 0 AND p LIKE 'p%')),
a AS (SELECT m, string_agg(p || '@' || t, ' ' ORDER BY p, t) AS x FROM w GROUP BY 1), b AS (SELECT m, string_agg(p || '@' || t, ' ' ORDER BY p, t) AS x FROM f GROUP BY 1)
SELECT m AS memory_id, coalesce(a.x, '') AS wanted, coalesce(b.x, '') AS found FROM a FULL JOIN b USING (m) WHERE a.x IS DISTINCT FROM b.x""",
}

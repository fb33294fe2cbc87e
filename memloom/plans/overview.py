"""Queries: overviews, states, checks, briefs, and erasure that erases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as Q
from ..operators import ledger as G
from ..operators import lifecycle as C
from ..operators import overview as V
from ..operators import procedures as M
from ..sources.projections import GRAPH_SQL, LEDGER_SQL, RECORDS_SQL, ledger, place_graph, records, table
from .ledger import _HELD, HOLDS, _orders


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with layers, holds and some vectors."""
    at = F.col("memory_id")
    layer = F.element_at(F.array(*map(F.lit, V.LAYERS)), (at % 5 + 1).cast("int"))
    status = F.when(at % 17 == 0, "deleted").when(at % 19 == 0, "retracted").otherwise(F.col("status"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding")
    rows = records(spark, sf_dir, with_status=True).join(vectors, "memory_id", "left")
    return rows.withColumns({"memory_layer": layer, "held": at % 10 == 3, "status": status})


def _children(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("memory_id"))
    pages = table(spark, sf_dir, "pages").select(F.element_at(F.array(*map(F.lit, ("en", "de", "none"))), (F.col("page_id") % 3 + 1).cast("int")).alias("tenant_id"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("memory_id"))
    return {"feedback": labels, "connectors": pages, "trigger_phrases": items}


def tenant_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.storage_overview(_layered(spark, sf_dir), _children(spark, sf_dir), {"embedding_models": table(spark, sf_dir, "region")})


def record_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of each document: labels as audit events, pages of its number as sources, neighbours as relations."""
    rows = _layered(spark, sf_dir).withColumn("fingerprint", F.sha2("content", 256))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 500).alias("memory_id"), F.col("page_id").alias("source_id"))
    connected = pages.where("source_id % 3 = 0").select("source_id")
    children = _children(spark, sf_dir)
    links = rows.select(F.col("memory_id").alias("src"), F.when(F.col("memory_id") % 4 == 0, F.col("memory_id")).otherwise(F.col("memory_id") + 1).alias("dst"))
    return V.storage_states(rows, pages, connected, children["trigger_phrases"], links, children["feedback"], rows.where("status = 'active'"))


def project_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("memory_id") % 7 == 0, "decision").when(F.col("memory_id") % 7 < 4, "fact").otherwise("workflow")
    keys = F.array(F.concat(F.lit("k"), F.col("memory_id") % 30), F.col("tenant_id"))
    rows = records(spark, sf_dir).withColumns({"kind": kind, "entity_keys": keys, "title": F.when(F.col("memory_id") % 3 > 0, F.concat(F.lit("No. "), F.col("memory_id").cast("string")))})
    rows = rows.withColumn("content", F.concat(F.lit("Text "), F.col("memory_id").cast("string")))
    found = V.project_overviews(rows, ["project_id"], newest=200)
    return found.select("project_id", "summary", F.array_join("key_entities", ",").alias("key_entities"), F.array_join("recent_decisions", ",").alias("recent_decisions"), "active_memory_count")


def _artifacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as artifacts of repositories (their sources): a manifest, and what is there."""
    at = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repository"), F.concat("source", F.lit("/d"), at.cast("string")).alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    path = F.when(at % 151 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    manifest = docs.withColumns({"path": path, "sha256": F.when(at % 97 == 0, F.lit("none")).when(at % 89 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256"))})
    return manifest, docs.where("doc_id % 83 <> 0").withColumn("bytes", F.when(at % 79 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))


def artifact_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, found = _artifacts(spark, sf_dir)
    return V.artifact_states(manifest, found)


def repository_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents as repositories: fingerprints of what they hold now and of what was recorded."""
    manifest, found = _artifacts(spark, sf_dir)
    states = V.artifact_states(manifest, found).join(manifest.select("path", "repository"), "path").where("repository IN ('src1', 'src2')")
    number = F.regexp_extract("repository", r"(\d+)$", 1).cast("int")
    print_of = F.sha2(F.concat_ws("|", F.min("sha256"), F.max("sha256"), F.count("*").cast("string")), 256)
    now = found.groupBy("repository").agg(print_of.alias("source_fingerprint"), F.count("*").alias("files"), F.sum("bytes").alias("symbols"))
    then = found.where("doc_id % 2 = 0 OR NOT repository IN ('src3', 'src4')").groupBy("repository").agg(print_of.alias("source_fingerprint"))
    sums = now.select("repository", F.sha2("source_fingerprint", 256).alias("memory_fingerprint"), F.col("files").alias("total"), F.floor(F.col("files") / 2).alias("active"))
    kept = then.join(sums.select("repository", "memory_fingerprint"), "repository").where(number % 6 != 5)
    kept = kept.withColumn("memory_fingerprint", F.when(number % 4 == 2, "old").otherwise(F.col("memory_fingerprint")))
    return V.repository_status(kept, now, sums, states)


def graph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as a graph of memories, stored with a few faults: an edge time, a lost node, a repeated artifact."""
    events = ledger(spark, sf_dir)
    node = lambda c: F.concat(F.lit("memory:"), F.col(c).cast("string"))
    nodes = events.select(node("id").alias("id"), F.lit("memory").alias("type"), F.lit(None).cast("string").alias("path"), F.col("created_at").alias("valid_from"))
    links = events.select("id", F.explode("supersedes").alias("old"), "created_at")
    edges = V.typed_edges(links.select(node("id").alias("src"), node("old").alias("dst"), F.lit("supersedes").alias("type"), F.col("created_at").alias("effective_at")))
    stored = edges.withColumn("effective_at", F.when(F.col("src") == "memory:7", None).otherwise(F.col("effective_at")))
    lost = nodes.where("id <> 'memory:3'")
    marks = events.agg(F.count("*").cast("string").alias("n"), F.sum("id").cast("string").alias("s"))
    ledgers = marks.select(F.length("s").cast("long").alias("bytes"), F.sha2("s", 256).alias("memory_fingerprint"), F.length("s").cast("long").alias("found_bytes"), F.sha2("s", 256).alias("found_fingerprint"))
    graph = marks.select(F.sha2("n", 256).alias("source"), F.sha2("s", 256).alias("memory"), F.sha2("n", 256).alias("map_source"), F.lit("x").alias("manifest_source"), F.sha2("s", 256).alias("manifest_memory"))
    graph = graph.withColumn("projection", F.sha2(F.concat("source", F.lit("\u0000"), "memory"), 256))
    manifest = ledgers.select(F.explode(F.array(F.lit("memory/events"), F.lit("graph"), F.lit("graph"))).alias("path"), "bytes", F.col("memory_fingerprint").alias("sha256"))
    return V.graph_checks(lost, stored, nodes, edges, manifest, ledgers, graph)


def boot_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as repositories: customers' segments as folders, suppliers as packages, orders' priorities as commands."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("repository"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("k"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("k"))
    folders = customers.groupBy("repository", F.lower("c_mktsegment").alias("directory")).agg(F.count("*").alias("file_count"))
    packages = suppliers.select("repository", F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").alias("name"), F.lit("npm").alias("ecosystem"), (F.col("s_suppkey") % 5).alias("n_dependencies"))
    commands = customers.where("c_custkey % 10 = 1").select("repository", F.concat(F.lit("run "), F.col("c_name")).alias("command"), F.lit(".").alias("cwd"), F.lit("Makefile").alias("source"))
    variables = folders.where("file_count % 2 = 0").select("repository", F.upper("directory").alias("name"), F.array(F.lit("a"), F.col("directory")).alias("paths"))
    files = customers.select("repository", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.floor("c_acctbal").alias("score"))
    sums = customers.groupBy("repository").agg(F.count("*").alias("files"), F.count_if(F.col("c_acctbal") > 0).alias("symbols"), F.max("k").alias("k"))
    even = F.col("k") % 2 == 0
    rows = sums.select("repository", F.when(even, F.concat(F.lit("Of "), "repository")).alias("description"), "files", "symbols", (F.col("files") + 1).alias("nodes"), F.col("files").alias("edges"),
                       F.when(even, F.array(F.lit("go"), F.lit("sql"))).otherwise(F.array().cast("array<string>")).alias("languages"), F.col("k").alias("active"))
    return V.boot_briefs(rows, folders, packages, commands, variables, files, most_bytes=1700)


def forgotten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who ask to be forgotten: their orders go with their lines and relations, unless a hold keeps them."""
    orders = _orders(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    near = orders.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"))
    asked = table(spark, sf_dir, "customer").where("c_custkey % 9 = 4").select(F.col("c_custkey").alias("o_custkey"))
    out = C.forgotten(orders, {"lines": lines, "relations": near}, HOLDS, "2001-08-02", "o_custkey", asked, "o_orderkey")
    left = [out[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k in ("records", "lines", "relations", "erased", "kept")]
    counts = left[0]
    for df in left[1:]:
        counts = counts.unionByName(df)
    each = out["events"].select(F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" held "), F.col("n_held").cast("string")).alias("name"), F.col("n_erased").alias("n"))
    return counts.unionByName(each)


def graph_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place graph at a day: nodes begin and end by number, edges begin by number."""
    edges = place_graph(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    day = lambda n: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(n)
    nodes = nodes.withColumns({"valid_from": F.when(number % 3 > 0, day(number % 40)), "valid_to": F.when(number % 4 == 1, day(number % 50))})
    ends = F.regexp_extract("dst", r"(\d+)$", 1).cast("int")
    kept, left = Q.induced_at(nodes, edges.withColumn("effective_at", F.when(ends % 2 == 0, day(ends % 45))), "2024-01-20 00:00:00")
    return left.select("src", "dst").unionByName(kept.select(F.col("id").alias("src"), F.lit("").alias("dst")))


def projection_renewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two projections in one store, the first of which is written anew."""
    row = lambda df, projection, key, payload: df.select(F.lit(projection).alias("projection"), F.lit("order").alias("kind"), F.col(key).cast("string").alias("id"), F.col(payload).alias("payload"))
    orders = table(spark, sf_dir, "orders")
    store = row(orders, "a", "o_orderkey", "o_orderstatus").unionByName(row(orders.where("o_orderkey % 5 = 0"), "b", "o_orderkey", "o_orderpriority"))
    new = row(orders.where("o_orderkey % 3 <> 1"), "a", "o_orderkey", "o_orderpriority").unionByName(row(orders.where("o_orderkey % 30 = 0"), "a", "o_orderkey", "o_orderstatus"))
    return G.projected(store, new.drop("projection"), "a")


def partition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some are kept, some left out, some both, and some neither."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    kept = ids.where("id % 3 <> 0").union(ids.where("id % 31 = 0")).union(ids.where("id % 47 = 1").select(-F.col("id") - 1))
    return G.partition_errors(ids, kept, ids.where("id % 3 = 0 AND id % 41 <> 0"))


def procedure_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as drafts of procedures over suppliers' files; half of the receipts of a day are there already."""
    at = F.col("o_orderkey")
    drafts = table(spark, sf_dir, "orders").select(
        at.alias("request_id"), (at % 4000).alias("receipt_id"), F.col("o_orderpriority").alias("title"), F.when(at % 29 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus")).alias("steps"),
        F.concat(F.lit("s"), (at % 120).cast("string")).alias("path"), (at % 7).alias("start_line"), (at % 9).alias("end_line"), F.when(at % 31 == 0, "tool").otherwise("agent").alias("authority"),
        F.when(at % 37 == 0, "restricted").otherwise("internal").alias("sensitivity"), F.col("o_orderdate").alias("created_at"),
    )
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), (F.col("s_suppkey") % 10).alias("lines"))
    none = spark.createDataFrame([], "receipt_id long, digest string")
    before = M.learned(drafts.where("request_id % 16 = 5"), none, files).where("verdict = 'written'").select("receipt_id", "digest")
    return M.learned(drafts, G.saved(before), files).select("request_id", "verdict")


def procedure_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as approvals of customers' procedures."""
    at, key = F.col("o_orderkey"), F.col("c_custkey")
    asked = table(spark, sf_dir, "orders").select(at.alias("request_id"), at.alias("receipt_id"), (F.col("o_custkey") * 11 % 1600).alias("procedure_id"), F.when(at % 6 == 0, "agent").otherwise("human").alias("authority"), F.col("o_orderdate").alias("created_at"))
    state = F.when(key % 5 == 0, "approved").otherwise("candidate")
    procedures = table(spark, sf_dir, "customer").select(key.alias("id"), state.alias("state"), (key % 7 != 1).alias("active"), F.concat(F.lit("f"), key % 50).alias("path"), F.when(key % 9 != 2, F.concat(F.lit("h"), key % 50)).alias("blob"))
    files = table(spark, sf_dir, "customer").where("c_custkey < 50").select(F.concat(F.lit("f"), key).alias("path"), F.concat(F.lit("h"), F.when(key == 13, 0).otherwise(key)).alias("sha256"))
    return M.approved(asked, procedures, files, spark.createDataFrame([], "receipt_id long, digest string")).select("request_id", "verdict")


def procedure_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as outcomes of customers' procedures, three to an episode."""
    at = F.col("o_orderkey")
    outcome = F.element_at(F.array(F.lit("success"), F.lit("failure"), F.lit("unknown"), F.lit("other")), (at % 4 + 1).cast("int"))
    outcomes = table(spark, sf_dir, "orders").select(
        at.alias("request_id"), at.alias("receipt_id"), F.floor(at / 3).alias("episode_id"), F.col("o_custkey").alias("procedure_id"), outcome.alias("outcome"), (at % 5 != 0).alias("verified"),
        F.when(at % 3 == 0, " ").otherwise("log").alias("evidence"), F.lit("agent").alias("authority"), F.lit("public").alias("sensitivity"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )
    procedures = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 8 == 0, "candidate").otherwise("approved").alias("state"), F.lit("1994-01-01").cast("timestamp_ntz").alias("created_at"))
    return M.reported(outcomes, procedures, spark.createDataFrame([], "receipt_id long, episode_id long, digest string")).select("request_id", "kind", "verdict")


QUERIES = {
    f.__name__: f
    for f in (
        tenant_storage, record_storage, project_summaries, artifact_states, repository_status, graph_checks, boot_briefs, forgotten_records, graph_at_time, projection_renewed, partition_problems,
        procedure_drafts, procedure_approvals, procedure_reports,
    )
}

_LAYERED = f"""{RECORDS_SQL}, m AS (
  SELECT memory_id, tenant_id, content, CASE WHEN memory_id % 17 = 0 THEN 'deleted' WHEN memory_id % 19 = 0 THEN 'retracted' ELSE status END AS status,
         ['conversation', 'session', 'user', 'agent', 'organization'][memory_id % 5 + 1] AS memory_layer, memory_id % 10 = 3 AS held, e.embedding FROM memories LEFT JOIN embeddings e ON e.vec_id = memory_id
)"""
_WAYS = """at AS (
  SELECT *, source || '/d' || doc_id AS path, strlen(text) AS bytes, sha256(text) AS h FROM documents
), manifest AS (
  SELECT doc_id, source, CASE WHEN doc_id % 151 = 0 THEN '../' || path ELSE path END AS path, bytes, CASE WHEN doc_id % 97 = 0 THEN 'none' WHEN doc_id % 89 = 0 THEN sha256(h) ELSE h END AS h FROM at
), found AS (SELECT doc_id, source, path, CASE WHEN doc_id % 79 = 0 THEN bytes + 1 ELSE bytes END AS bytes, h FROM at WHERE doc_id % 83 <> 0),
states AS (
  SELECT m.path, m.source, CASE WHEN m.path LIKE '../%' OR m.h = 'none' THEN 'invalid' WHEN f.h IS NULL THEN 'missing' WHEN f.bytes <> m.bytes OR f.h <> m.h THEN 'changed' ELSE 'current' END AS state
  FROM manifest m LEFT JOIN found f USING (path)
)""".replace("at AS", "files AS", 1).replace("FROM at", "FROM files")

ORACLES = {
    "tenant_storage": f"""WITH {_LAYERED}, own AS (
  SELECT tenant_id, count(*) AS memories_total, {', '.join(f"count(*) FILTER (status = '{s}') AS memories_{s}" for s in V.STATES)}, count(*) FILTER (held) AS memories_held,
         {', '.join(f"count(*) FILTER (memory_layer = '{x}') AS {x}_layer_total" for x in V.LAYERS)}, count(*) FILTER (len(embedding) > 0) AS vectorized_memories FROM m GROUP BY 1
), feedback AS (SELECT tenant_id, count(*) AS n FROM labels JOIN m ON memory_id = doc_id GROUP BY 1), connectors AS (SELECT ['en', 'de', 'none'][page_id % 3 + 1] AS tenant_id, count(*) AS n FROM pages GROUP BY 1),
triggers AS (SELECT tenant_id, count(*) AS n FROM benchmark JOIN m ON memory_id = item_id GROUP BY 1), tenants AS (SELECT tenant_id FROM own UNION SELECT tenant_id FROM connectors)
SELECT tenant_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ['memories_total', *(f'memories_{s}' for s in V.STATES), 'memories_held', *(f'{x}_layer_total' for x in V.LAYERS), 'vectorized_memories'])},
  coalesce(f.n, 0) AS feedback_total, coalesce(c.n, 0) AS connectors_total, coalesce(t.n, 0) AS trigger_phrases_total, (SELECT count(*) FROM region) AS embedding_models_total
FROM tenants LEFT JOIN own USING (tenant_id) LEFT JOIN feedback f USING (tenant_id) LEFT JOIN connectors c USING (tenant_id) LEFT JOIN triggers t USING (tenant_id)""",
    "record_storage": f"""WITH {_LAYERED} SELECT memory_id, sha256(content) AS fingerprint, coalesce(len(embedding), 0)::BIGINT AS embedding_dimensions,
  (SELECT count(*) FROM pages WHERE page_id % 500 = memory_id) AS source_reference_count, (SELECT count(DISTINCT page_id) FROM pages WHERE page_id % 500 = memory_id AND page_id % 3 = 0) AS connected_source_count,
  (SELECT count(*) FROM benchmark WHERE item_id = memory_id) AS trigger_phrase_count,
  1 + CASE WHEN memory_id % 4 <> 1 AND memory_id - 1 IN (SELECT memory_id FROM m) THEN 1 ELSE 0 END AS relation_count,
  (SELECT count(*) FROM labels WHERE doc_id = memory_id) AS audit_event_count, status = 'active' AS fts_indexed, memory_id IN (SELECT item_id FROM benchmark) AS trigger_indexed FROM m""",
    "project_summaries": f"""WITH {RECORDS_SQL}, r AS (
  SELECT memory_id, project_id, tenant_id, CASE WHEN memory_id % 7 = 0 THEN 'decision' WHEN memory_id % 7 < 4 THEN 'fact' ELSE 'workflow' END AS kind,
         CASE WHEN memory_id % 3 > 0 THEN 'No. ' || memory_id ELSE 'Text ' || memory_id END AS t, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, memory_id) AS r FROM memories
), s AS (SELECT * FROM r WHERE r <= 200), k AS (
  SELECT project_id, string_agg(n || ' ' || kind || 's', ', ' ORDER BY n DESC, f) AS t FROM (SELECT project_id, kind, count(*) AS n, min(r) AS f FROM s GROUP BY 1, 2) GROUP BY 1
), e AS (
  SELECT project_id, entity, row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, min(r * 10 + p)) AS k
  FROM (SELECT project_id, 'k' || memory_id % 30 AS entity, r, 0 AS p FROM s UNION ALL SELECT project_id, tenant_id, r, 1 FROM s) GROUP BY 1, 2
), g AS (SELECT project_id, string_agg(entity, ',' ORDER BY k) AS ks, string_agg(entity, ', ' ORDER BY k) FILTER (k <= 5) AS five FROM e WHERE k <= 20 GROUP BY 1),
d AS (SELECT project_id, string_agg(t, ',' ORDER BY r) AS t FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY r) AS k FROM s WHERE kind = 'decision') WHERE k <= 10 GROUP BY 1), c AS (SELECT project_id, count(*) AS n FROM s GROUP BY 1)
SELECT project_id, 'Project has ' || n || ' memories, ' || k.t || '. Key entities: ' || five || '.' AS summary, ks AS key_entities, coalesce(d.t, '') AS recent_decisions, n AS active_memory_count
FROM c JOIN k USING (project_id) JOIN g USING (project_id) LEFT JOIN d USING (project_id)""",
    "artifact_states": f"WITH {_WAYS} SELECT path, state FROM states",
    "repository_status": f"""WITH {_WAYS}, now AS (
  SELECT source, sha256(min(h) || '|' || max(h) || '|' || count(*)) AS p, count(*) AS files, sum(bytes)::BIGINT AS symbols FROM found GROUP BY 1
), old AS (SELECT source, sha256(min(h) || '|' || max(h) || '|' || count(*)) AS p FROM found WHERE doc_id % 2 = 0 OR source NOT IN ('src3', 'src4') GROUP BY 1),
bad AS (SELECT DISTINCT source FROM states WHERE state <> 'current' AND source IN ('src1', 'src2')), j AS (
  SELECT now.*, regexp_extract(now.source, '([0-9]+)$', 1)::INT AS n, old.p AS was, bad.source IS NOT NULL AS bad FROM now LEFT JOIN old USING (source) LEFT JOIN bad USING (source)
), w AS (
  SELECT *, list_filter([CASE WHEN n % 6 = 5 OR was IS NULL THEN 'not initialized' END, CASE WHEN n % 6 <> 5 AND was <> p THEN 'sources changed' END, CASE WHEN n % 6 <> 5 AND was IS NOT NULL AND n % 4 = 2 THEN 'ledger changed' END,
    CASE WHEN bad THEN 'artifacts changed' END], lambda x: x IS NOT NULL) AS l FROM j
) SELECT source AS repository, len(l) = 0 AS current, coalesce(array_to_string(l, '; '), '') AS reasons, files, symbols, files // 2 AS active, files AS total FROM w""",
    "graph_checks": f"""WITH {LEDGER_SQL}, f AS (SELECT bool_or(id = 3) AS three, bool_or(id = 3 OR prior = 3) FILTER (prior IS NOT NULL) AS cut, bool_or(id = 7 AND prior IS NOT NULL) AS seven, bool_or(id = 3 AND prior IS NOT NULL) AS own FROM ledger)
SELECT unnest(['stored-manifest-artifact-set', 'stored-memory-snapshot', 'stored-ledger-attestation', 'stored-source-fingerprint', 'stored-graph-identities', 'stored-graph-references', 'stored-memory-fingerprint',
  'stored-projection-fingerprint', 'stored-temporal-nodes', 'stored-temporal-edges', 'stored-canonical-nodes', 'stored-canonical-edges']) AS "check",
  unnest([false, true, true, false, true, NOT coalesce(cut, false), true, true, true, NOT coalesce(seven OR own, false), NOT three, true]) AS passed FROM f""",
    "boot_briefs": """WITH c AS (SELECT *, n_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey), fo AS (SELECT r, lower(c_mktsegment) AS d, count(*) AS n FROM c GROUP BY 1, 2),
f AS (SELECT r, string_agg('- `' || d || '/` — ' || n || ' files', chr(10) ORDER BY n DESC, d) AS t FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, d) AS k FROM fo) WHERE k <= 15 GROUP BY 1),
p AS (SELECT r, string_agg('- `p' || s_suppkey || '` — ' || s_name || ' (npm; ' || s_suppkey % 5 || ' dependencies)', chr(10) ORDER BY k) AS t
  FROM (SELECT *, n_name AS r, row_number() OVER (PARTITION BY n_name ORDER BY 'p' || s_suppkey) AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey) WHERE k <= 20 GROUP BY 1),
m AS (SELECT r, string_agg('- `run ' || c_name || '` from `.` (declared by `Makefile`)', chr(10) ORDER BY k) AS t FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c_name) AS k FROM c WHERE c_custkey % 10 = 1) WHERE k <= 30 GROUP BY 1),
v AS (SELECT r, string_agg('- `' || upper(d) || '` — `a`, `' || d || '`', chr(10) ORDER BY upper(d)) AS t FROM fo WHERE n % 2 = 0 GROUP BY 1),
k AS (SELECT r, string_agg('- `c' || c_custkey || '`', chr(10) ORDER BY k) AS t FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY floor(c_acctbal) DESC, 'c' || c_custkey) AS k FROM c) WHERE k <= 18 GROUP BY 1),
s AS (SELECT r, count(*) AS files, count(*) FILTER (c_acctbal > 0) AS symbols, max(n_nationkey) AS k FROM c GROUP BY 1),
b AS (SELECT s.r AS repository, concat_ws(chr(10), '# ' || s.r || ' repo brain', '', '## Repository', '', CASE WHEN s.k % 2 = 0 THEN 'Repository-declared description: Of ' || s.r ELSE s.r || ' repository' END, '',
  '- Files / symbols / graph: ' || files || ' / ' || symbols || ' / ' || files + 1 || ' nodes, ' || files || ' edges', '- Languages: ' || CASE WHEN s.k % 2 = 0 THEN 'go, sql' ELSE 'none detected' END, '- Active memories: ' || s.k,
  chr(10) || '## Repository map' || chr(10), coalesce(f.t, '- _Single-directory repository._'), chr(10) || '## Packages and services' || chr(10), coalesce(p.t, '- _No supported package manifests detected._'),
  chr(10) || '## Declared commands' || chr(10), coalesce(m.t, '- _No explicit package scripts or Make targets detected._'), chr(10) || '## Environment contract' || chr(10), coalesce(v.t, '- _No declared environment-variable names detected._'),
  chr(10) || '## Key files' || chr(10), coalesce(k.t, '')) AS brief FROM s LEFT JOIN f USING (r) LEFT JOIN p USING (r) LEFT JOIN m USING (r) LEFT JOIN v USING (r) LEFT JOIN k USING (r))
SELECT repository, brief, strlen(brief) <= 1700 AS fits FROM b""",
    "forgotten_records": f"""WITH {_HELD}, a AS (SELECT o.o_orderkey, o.o_custkey, len(r) > 0 AS h, o.o_custkey % 9 = 4 AS asked FROM o JOIN held USING (o_orderkey)), gone AS (SELECT o_orderkey FROM a WHERE asked AND NOT h)
SELECT 'records' AS name, count(*) AS n FROM a WHERE NOT (asked AND NOT h) UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'relations', count(*) FROM a WHERE o_orderkey NOT IN (SELECT * FROM gone) AND o_orderkey + 1 NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'erased', count(*) FROM gone UNION ALL SELECT 'kept', count(*) FROM a WHERE asked AND h
UNION ALL SELECT 'customer ' || c_custkey || ' held ' || count(o_orderkey) FILTER (h), count(o_orderkey) FILTER (NOT h) FROM customer LEFT JOIN a ON o_custkey = c_custkey WHERE c_custkey % 9 = 4 GROUP BY c_custkey""",
    "graph_at_time": f"""WITH {GRAPH_SQL}, n AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), d AS (SELECT id, regexp_extract(id, '([0-9]+)$', 1)::INT AS k FROM n),
kept AS (SELECT id FROM d WHERE (k % 3 = 0 OR k % 40 <= 19) AND (k % 4 <> 1 OR k % 50 > 19))
SELECT src, dst FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) AND (regexp_extract(dst, '([0-9]+)$', 1)::INT % 2 = 1 OR regexp_extract(dst, '([0-9]+)$', 1)::INT % 45 <= 19)
UNION ALL SELECT id, '' FROM kept""",
    "projection_renewed": """SELECT 'b' AS projection, 'order' AS kind, o_orderkey::VARCHAR AS id, o_orderpriority AS payload FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'a', 'order', o_orderkey::VARCHAR, CASE WHEN o_orderkey % 30 = 0 THEN greatest(o_orderpriority, o_orderstatus) ELSE o_orderpriority END FROM orders WHERE o_orderkey % 3 <> 1""",
    "partition_problems": """WITH n AS (SELECT doc_id AS id, (doc_id % 3 <> 0)::INT + (doc_id % 31 = 0)::INT AS k, (doc_id % 3 = 0 AND doc_id % 41 <> 0)::INT AS o FROM documents)
SELECT id, CASE WHEN k > 0 AND o > 0 THEN 'kept and omitted' WHEN k + o = 0 THEN 'lost' ELSE 'repeated' END AS problem FROM n WHERE k + o <> 1
UNION ALL SELECT -doc_id - 1, 'not supplied' FROM documents WHERE doc_id % 47 = 1""",
    "procedure_drafts": """WITH d AS (
  SELECT o_orderkey AS k, o_orderkey % 4000 AS receipt, o_orderdate AS ts, concat_ws('|', o_orderpriority, CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE o_orderstatus END, o_orderkey % 120, o_orderkey % 7, o_orderkey % 9) AS c, s_suppkey % 10 AS n FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 120
), r AS (
  SELECT *, CASE WHEN n IS NULL THEN 'no such source' WHEN k % 9 < k % 7 THEN 'lines out of order' WHEN greatest(k % 9, k % 7) > n THEN 'lines beyond the source' WHEN k % 31 = 0 THEN 'no reporter'
    WHEN k % 37 = 0 THEN 'sensitive' WHEN k % 29 = 0 THEN 'no steps' END AS rule FROM d
), b AS (SELECT receipt, arg_min(c, (ts, k)) AS held FROM r WHERE k % 16 = 5 AND rule IS NULL GROUP BY 1),
f AS (SELECT r.*, held, first_value(c) OVER w AS one, row_number() OVER w AS i FROM r LEFT JOIN b USING (receipt) WINDOW w AS (PARTITION BY receipt, rule IS NULL AND held IS NULL ORDER BY ts, k))
SELECT k AS request_id, CASE WHEN held = c THEN 'known' WHEN held IS NOT NULL THEN 'receipt was used' WHEN rule IS NOT NULL THEN rule WHEN i = 1 THEN 'written' WHEN one = c THEN 'known' ELSE 'receipt was used' END AS verdict FROM f""",
    "procedure_approvals": """WITH a AS (SELECT o_orderkey AS k, o_custkey * 11 % 1600 AS p, o_orderdate AS ts FROM orders), r AS (
  SELECT k, p, ts, CASE WHEN c_custkey IS NULL THEN 'no such procedure' WHEN k % 6 = 0 THEN 'needs human authority' WHEN p % 5 = 0 THEN 'not a candidate' WHEN p % 7 = 1 THEN 'no longer active'
    WHEN p % 9 = 2 OR p % 50 = 13 OR p % 50 NOT IN (SELECT c_custkey FROM customer) THEN 'source has changed' END AS rule FROM a LEFT JOIN customer ON c_custkey = p
) SELECT k AS request_id, CASE WHEN rule IS NOT NULL THEN rule WHEN row_number() OVER (PARTITION BY p, rule IS NULL ORDER BY ts, k) > 1 THEN 'approved before' ELSE 'written' END AS verdict FROM r""",
    "procedure_reports": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS p, o_orderdate AS ts, first_value(o_orderkey) OVER (PARTITION BY o_orderkey // 3 ORDER BY o_orderdate, o_orderkey) AS one FROM orders)
SELECT k AS request_id, CASE WHEN k % 4 = 1 THEN 'mistake' ELSE 'fact' END AS kind, CASE WHEN c_custkey IS NULL OR p % 8 = 0 THEN 'no approved version' WHEN ts < TIMESTAMP '1994-01-01' THEN 'predates its version' WHEN k % 4 = 3 THEN 'no such outcome'
  WHEN k % 4 = 0 AND k % 5 = 0 THEN 'not verified' WHEN k % 4 = 1 AND k % 3 = 0 THEN 'no evidence' WHEN one <> k THEN 'episode has another receipt' ELSE 'written' END AS verdict
FROM o LEFT JOIN customer ON c_custkey = p""",
}

"""Queries: the graph of a source tree, packets, views, lookups, and the ledger's stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as E
from ..operators import filters as L
from ..operators import graph as Q
from ..operators import packet as P
from ..operators import records as D
from ..operators import repo_graph as H
from ..operators import upkeep as U
from ..operators.ledger import saved
from ..sources import repository as Y
from ..sources.projections import AS_OF, LEDGER_SQL, RECORDS_SQL, ledger, place_graph, records, table
from ..streaming import sync as W
from . import knowledge
from .code import _CODE, _files


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    files = saved(_files(spark, sf_dir))
    links = Y.resolved_imports(Y.imports(files), files)
    key = F.col("c_custkey")
    source = F.struct(F.concat(F.lit("src/c"), key.cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("C"), key.cast("string")).alias("symbol"))
    memories = table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"), F.col("c_name").alias("title"), F.when(key % 2 == 1, F.array((key - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("supersedes"), F.array(source).alias("sources"),
    )
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("src/n"), F.col("n_nationkey").cast("string"), F.lit(".ts")).alias("path"), F.col("n_name").alias("name"), F.array(F.lit("NATION_3"), F.lit("none")).alias("dependencies")
    )
    return files, Y.symbols(files), links, nations, memories


def repository_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the source tree by type."""
    nodes, edges = H.build(*_parts(spark, sf_dir))
    count = lambda df, what: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
    faults = H.integrity(nodes, edges).select(F.lit("fault").alias("what"), F.col("check").alias("type"), "n")
    return count(nodes, "node").unionByName(count(edges, "edge")).unionByName(faults)


def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].select("path", "specifier", "target")


def tested_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols, *_ = _parts(spark, sf_dir)
    return H.test_relations(files, symbols)


def key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that matter most by made-up ranks; manifests and readmes count more."""
    docs = table(spark, sf_dir, "documents")
    names = F.element_at(F.array(*map(F.lit, ("a.py", "README.md", "package.json", "x.md"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = docs.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), names).alias("path")).withColumn("kind", Y.file_kind(F.col("path")))
    ids = files.withColumn("id", H.node_id("file", F.col("path")))
    ranks = ids.select("id", (F.col("doc_id") % 50 / F.lit(1000.0)).alias("rank"))
    degrees = ids.where("doc_id % 3 = 0").select("id", (F.col("doc_id") % 7 / F.lit(10.0)).alias("centrality"))
    return H.key_files(files, ranks, degrees).select("path", F.round("score", 6).alias("score"))


def package_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packages of four ecosystems."""
    key, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    kinds = {
        "package.json": F.concat(F.lit('{"name": "'), name, F.lit('", "scripts": {"test": "t", "build": "b"}, "dependencies": {"d'), key, F.lit('": "1"}, "devDependencies": {"a": "2"}}')),
        "pyproject.toml": F.concat(F.lit('[project]\nname = "'), name, F.lit('"\n')),
        "go.mod": F.concat(F.lit("module m/"), key, F.lit("\n\nrequire (\n\texample.org/x v1.2.3\n)\n")),
        "Cargo.toml": F.concat(F.lit('[package]\nname = "'), name, F.lit('"\n[dependencies]\nserde = "1"\nb-c = { path = "." }\n[features]\nz = "1"\n')),
    }
    files = list(kinds)
    which = F.col("s_suppkey") % 4
    path = F.concat(F.lit("p"), key, F.lit("/"), F.element_at(F.array(*map(F.lit, files)), (which + 1).cast("int")))
    content = F.element_at(F.array(*kinds.values()), (which + 1).cast("int"))
    found = Y.package_manifests(table(spark, sf_dir, "supplier").select(path.alias("path"), content.alias("content")))
    return found.select("path", "name", "ecosystem", F.array_join("dependencies", ",").alias("dependencies"), F.coalesce(F.array_join("commands", ","), F.lit("")).alias("commands"))


def environment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables that parts' files read: by brand, in the forms of five languages."""
    brand = F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"))
    forms = ("process.env.{}", "os.environ['{}']", 'os.getenv("{}")', 'os.Getenv("{}")', 'env::var("{}")')
    wrapped = F.element_at(F.array(*[F.concat(F.lit(f.split("{}")[0]), brand, F.lit(f.split("{}")[1])) for f in forms]), (F.col("p_partkey") % 5 + 1).cast("int"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 100).cast("string")).alias("path"), F.concat(F.lit("x = "), wrapped).alias("content"))
    return Y.environment_variables(files).select("name", F.array_join("paths", ",").alias("paths"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates of all types; near ones are a seed's neighbours."""
    kind = F.element_at(F.array(*map(F.lit, P.POINTS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), kind.alias("type"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("parts/"), "p_brand")).alias("path"), F.col("p_name").alias("name"),
        F.col("p_type").alias("text"), (F.col("p_partkey") % 10 / F.lit(10.0)).alias("importance"), F.lit(0.5).alias("confidence"),
        F.when(F.col("p_partkey") % 11 == 0, "restricted").otherwise("public").alias("sensitivity"), "p_brand",
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    near = rows.where("CAST(id AS INT) % 13 = 0").select("id", (F.col("id").cast("int") % 3).cast("long").alias("depth"))
    graph = rows.select("id", (F.col("id").cast("int") % 4 / F.lit(2.0)).alias("graph_score"))
    return P.visible(P.boosted(P.scored(rows, "PROMO brushed steel, and the COPPER", graph), near))


def packet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("id", "type", "exact", "overlap", F.round("score", 4).alias("score"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet of 900 bytes for each brand."""
    return P.packed(_judged(spark, sf_dir).withColumn("score", F.round("score", 4)), ["p_brand"], 900, 10_000)


def pseudo_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = E.pseudo_embedding(F.col("text"), 20)
    rows = table(spark, sf_dir, "documents").select("doc_id", vector.alias("v"))
    return rows.select("doc_id", *[F.round(F.get("v", F.lit(k)), 9).alias(f"v{k}") for k in (0, 7, 8, 19)], F.size("v").alias("n"))


def newline_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with old line ends hash like those with new ones."""
    docs = table(spark, sf_dir, "documents").withColumn("old", F.regexp_replace("text", "\n", "\r\n"))
    same = F.sha2(T.canonical_newlines(F.col("old")), 256)
    return docs.select("doc_id", same.alias("sha256"), (same == F.sha2(T.canonical_newlines(F.col("text")), 256)).alias("same"))


def record_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ledger(spark, sf_dir).withColumns({
        "title": F.concat(F.lit("t"), F.col("id") % 7), "importance": F.col("id") % 5 / F.lit(5.0), "sensitivity": F.when(F.col("id") % 6 == 0, "restricted"),
    })
    return D.view(events, ["click", "purchase"]).select("id", "title", "importance")


def dirty_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda t, k: table(spark, sf_dir, t).select(F.concat(F.lit("f"), F.col(k).cast("string")).alias("path"))
    return D.dirty_paths(path("nation", "n_nationkey"), path("supplier", "s_suppkey"), path("region", "r_regionkey"))


def purged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, chunks and relations that are left once every fifth source's files are gone."""
    rows = records(spark, sf_dir).select("memory_id", F.concat("project_id", F.lit("/"), (F.col("memory_id") % 40).cast("string")).alias("path"))
    chunks = rows.select("path", (F.col("memory_id") % 3).alias("chunk"))
    links = rows.select(F.col("memory_id").alias("src"), (F.col("memory_id") + 1).alias("dst"))
    gone = rows.where("memory_id % 5 = 0").select("path")
    left = D.purged(rows, chunks, links, gone)
    out = None
    for name, df in zip(("records", "chunks", "relations", "erased"), left, strict=True):
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def memory_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records within two steps of three seeds, and the relations among them."""
    rows = records(spark, sf_dir).where("memory_id % 9 <> 5").withColumn("valid_from", F.lit(None).cast("timestamp_ntz"))
    links = rows.select(F.col("memory_id").alias("src"), F.explode(F.array(F.col("memory_id") + 7, F.col("memory_id") * 2)).alias("dst")).where("src <> dst")
    seeds = rows.where("memory_id IN (3, 10, 100)").select("memory_id")
    nodes, edges = D.memory_graph(rows, links, seeds, 2, 30)
    return nodes.select(F.col("memory_id").alias("src"), F.lit(-1).cast("long").alias("dst")).unionByName(edges.select("src", "dst"))


def graph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = place_graph(spark, sf_dir)
    nodes = saved(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    ranks = Q.pagerank(nodes, edges, 20).select("id", F.round("rank", 6).alias("rank"))
    degrees = Q.degree_centrality(nodes, edges).select("id", F.round("centrality", 9).alias("centrality"))
    return Q.graph_score(ranks, degrees).select("id", F.round("graph_score", 6).alias("graph_score"))


def kinds_and_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against records if only two kinds and two layers are asked for."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.col("memory_id") % k + 1).cast("int"))
    rows = records(spark, sf_dir).withColumns({"kind": pick(("fact", "decision", "workflow"), 3), "memory_layer": pick(("user", "agent", "session", "organization"), 4)})
    request = L.Request(tenant_id="en", kinds=("fact", "workflow"), layers=("user", "session"), as_of=AS_OF)
    return rows.select("memory_id", F.array_join(L.rejection_reasons(rows, request), "; ").alias("reasons"))


def inspected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their two newest purchases and errors."""
    events = ledger(spark, sf_dir).select(F.col("user_id").alias("memory_id"), (F.col("created_at") + F.make_dt_interval(secs=F.col("id") / 1000000.0)).alias("created_at"), "id", "kind")
    users = events.select("memory_id").distinct()
    found = D.inspection(users, {"purchases": events.where("kind = 'purchase'").drop("kind"), "errors": events.where("kind = 'error'").drop("kind")}, newest=2)
    shown = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["id"].cast("string")), ","), F.lit("")).alias(c)
    return found.select("memory_id", shown("purchases"), shown("errors"))


def maintenance_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids and paths of the first task of a plan over documents of one text."""
    docs = records(spark, sf_dir).withColumn("h", F.sha2("content", 256))
    groups = docs.groupBy("h").agg(F.collect_set(F.col("memory_id").cast("string")).alias("memory_ids"), F.collect_set("project_id").alias("paths"))
    issues = groups.where(F.size("memory_ids") > 1).select(F.lit(U.ISSUE_KINDS[0]).alias("kind"), "memory_ids", "paths")
    ids, paths = U.task_selectors(saved(U.maintenance_plan(issues)), 1, docs)
    return spark.createDataFrame([(",".join(ids), ",".join(paths))], "memory_ids string, paths string")


def synced_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger streamed in three batches: events of odd and of even number, then some again, retracted; a tenth of the users is erased."""
    saved(spark.range(1))
    root = f"{spark.sparkContext.getCheckpointDir()}/sync-{uuid.uuid4()}"
    events = ledger(spark, sf_dir).select("id", F.col("created_at").cast("timestamp").alias("created_at"), "status", "supersedes", "user_id")
    gone = events.where("user_id % 10 = 3").select("id")
    run = lambda: W.sync(spark.readStream.schema(events.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/marks", gone).awaitTermination()
    for part in (events.where("id % 2 = 1"), events.where("id % 2 = 0"), events.where("id % 50 = 0").withColumn("status", F.lit("retracted"))):
        part.write.mode("append").parquet(f"{root}/in")
        run()
    found = W.newest(spark, f"{root}/out")
    return found.select("id", "status", F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss").alias("valid_to"))


QUERIES = {
    f.__name__: f
    for f in (
        repository_graph, import_targets, tested_symbols, key_files, package_manifests, environment_names, packet_scores, packets, pseudo_embeddings, newline_hashes, record_view, dirty_paths, purged_files,
        memory_neighbourhood, graph_scores, kinds_and_layers, inspected_records, maintenance_selectors, synced_ledger,
    )
}

_TOKENS = "list_filter(string_split_regex(lower({}), '[^a-z0-9_./:@-]+'), lambda t: length(t) > 1 AND t NOT IN ('" + "', '".join(P.STOP_WORDS) + "'))"
_STEMS = "list_distinct({0} || list_filter(list_transform({0}, lambda t: CASE WHEN length(t) >= 8 AND t LIKE '%ion' THEN left(t, length(t) - 3) WHEN length(t) >= 6 AND t LIKE '%e' THEN left(t, length(t) - 1) END), lambda t: t IS NOT NULL))"
_JUDGED = f"""c AS (
  SELECT p_partkey AS k, p_partkey::VARCHAR AS id, ['file', 'symbol', 'command', 'env', 'memory'][p_partkey % 5 + 1] AS type, CASE WHEN p_partkey % 2 = 0 THEN 'parts/' || p_brand END AS path, p_name AS name, p_type AS text, p_brand FROM part
), t AS (SELECT *, {_TOKENS.format("concat_ws(' ', path, name, text)")} AS w, {_TOKENS.format("'PROMO brushed steel, and the COPPER'")} AS q FROM c),
o AS (SELECT *, len(list_intersect({_STEMS.format("w")}, {_STEMS.format("q")})) AS overlap FROM t),
s AS (
  SELECT *, 0 AS exact, overlap * CASE type WHEN 'file' THEN 45 WHEN 'symbol' THEN 55 WHEN 'memory' THEN 60 ELSE 50 END + CASE WHEN type = 'memory' AND overlap > 0 THEN 30 * (k % 10 / 10.0::DOUBLE) + 7.5::DOUBLE ELSE 0 END
    + k % 4 / 2.0::DOUBLE + CASE WHEN k % 13 = 0 AND k % 3 > 0 THEN 20 ELSE 0 END AS score FROM o
), judged AS (SELECT id, type, exact, overlap, round(score, 4) AS score, name, text, path, p_brand FROM s WHERE (overlap > 0 OR k % 13 = 0) AND k % 11 <> 0)"""

ORACLES = {
    "repository_graph": f"""WITH {_CODE}, n AS (SELECT count(*) AS c, count(*) FILTER (k % 5 = 0) AS t, count(*) FILTER (k % 2 = 1) AS odd, (SELECT count(*) FROM nation) AS n, count(*) FILTER (k % 2 = 1 AND k - 1 IN (SELECT k FROM c)) AS known FROM c)
SELECT unnest(['node', 'node', 'node', 'node', 'node', 'edge', 'edge', 'edge', 'edge', 'edge', 'edge', 'edge', 'fault', 'fault', 'fault', 'fault']) AS what,
  unnest(['file', 'directory', 'symbol', 'package', 'memory', 'contains', 'defines', 'declares', 'depends_on', 'imports', 'supersedes', 'cites', 'repeated id', 'no source node', 'no target node', 'edge to itself']) AS type,
  unnest([c + t + n, 2, 3 * c + t + n, n, c, c + t + n + 1, 3 * c + t + n, n, n, c + t, odd, 2 * c, 0, 0, odd - known, 1]) AS n FROM n""",
    "import_targets": f"""WITH {_CODE} SELECT 'src/c' || k || '.ts' AS path, './n' || c_nationkey AS specifier, 'src/n' || c_nationkey || '.ts' AS target FROM c
UNION ALL SELECT 'src/c' || k || '.test.ts', './c' || k, 'src/c' || k || '.ts' FROM c WHERE k % 5 = 0""",
    "tested_symbols": f"""WITH {_CODE} SELECT 'src/c' || k || '.test.ts' AS test_path, 'src/c' || k || '.ts' AS path, unnest(['C' || k, 'total' || k, 'T' || k]) AS name FROM c WHERE k % 5 = 0""",
    "key_files": """WITH f AS (SELECT doc_id, 'd' || doc_id || '/' || ['a.py', 'README.md', 'package.json', 'x.md'][doc_id % 4 + 1] AS path FROM documents)
SELECT path, round(10 * (doc_id % 50 / 1000.0::DOUBLE) + CASE WHEN doc_id % 3 = 0 THEN 4 * (doc_id % 7 / 10.0::DOUBLE) ELSE 0 END + [0.2, 0.3, 0.5, 0][doc_id % 4 + 1]::DOUBLE, 6) AS score FROM f ORDER BY 2 DESC, 1 LIMIT 18""",
    "package_manifests": """SELECT 'p' || s_suppkey || '/' || ['package.json', 'pyproject.toml', 'go.mod', 'Cargo.toml'][s_suppkey % 4 + 1] AS path, CASE WHEN s_suppkey % 4 = 2 THEN 'm/' || s_suppkey ELSE s_name END AS name,
  ['npm', 'pypi', 'go', 'cargo'][s_suppkey % 4 + 1] AS ecosystem, ['a,d' || s_suppkey, '', 'example.org/x', 'b-c,serde'][s_suppkey % 4 + 1] AS dependencies, CASE WHEN s_suppkey % 4 = 0 THEN 'build,test' ELSE '' END AS commands FROM supplier""",
    "environment_names": """SELECT upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) AS name, string_agg(DISTINCT 'f' || p_partkey % 100, ',' ORDER BY 'f' || p_partkey % 100) AS paths FROM part GROUP BY 1""",
    "packet_scores": f"WITH {_JUDGED} SELECT id, type, exact, overlap::INT AS overlap, score FROM judged",
    "packets": f"""WITH {_JUDGED}, b AS (
  SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, type, id) AS k, '## ' || type || ' ' || name || chr(10) || '> ' || text || chr(10) || 'Source: ' || coalesce(path, id) || chr(10) AS b FROM judged
), l AS (SELECT p_brand, list(b ORDER BY k) AS bs FROM b WHERE k <= 200 GROUP BY 1), f AS (
  SELECT p_brand, list_reduce(bs, lambda a, x: CASE WHEN NOT a.open THEN a WHEN strlen(a.t) + strlen(x.t) <= 900 THEN {{'t': a.t || x.t, 'n': a.n + 1, 'open': true}}
    WHEN strlen(a.t) < 900 THEN {{'t': a.t || left(x.t, 900 - strlen(a.t)), 'n': a.n + 1, 'open': false}} ELSE {{'t': a.t, 'n': a.n, 'open': false}} END, {{'t': '', 'n': 0::BIGINT, 'open': true}}) AS p
  FROM (SELECT p_brand, list_transform(bs, lambda x: {{'t': x, 'n': 0::BIGINT, 'open': true}}) AS bs FROM l)
) SELECT p_brand, p.t AS packet, p.n AS n_items FROM f""",
    "pseudo_embeddings": """WITH h AS (SELECT doc_id, list_transform(range(0, 20), lambda i: ('0x' || substr(sha256(text || (i // 8)::VARCHAR), (i % 8 * 8 + 1)::BIGINT, 8))::BIGINT / 2147483647.5::DOUBLE - 1) AS v FROM documents),
n AS (SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12::DOUBLE) AS n FROM h)
SELECT doc_id, round(v[1] / n, 9) AS v0, round(v[8] / n, 9) AS v7, round(v[9] / n, 9) AS v8, round(v[20] / n, 9) AS v19, len(v)::INT AS n FROM n""",
    "newline_hashes": r"SELECT doc_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS sha256, true AS same FROM documents",
    "record_view": f"""WITH {LEDGER_SQL} SELECT id, 't' || id % 7 AS title, id % 5 / 5.0::DOUBLE AS importance FROM ledger
WHERE status = 'active' AND kind IN ('click', 'purchase') AND id % 6 <> 0 AND id NOT IN (SELECT prior FROM ledger WHERE prior IS NOT NULL)""",
    "dirty_paths": "SELECT * FROM (SELECT 'f' || n_nationkey AS path FROM nation UNION SELECT 'f' || s_suppkey FROM supplier UNION SELECT 'f' || r_regionkey FROM region) ORDER BY 1 LIMIT 200",
    "purged_files": f"""WITH {RECORDS_SQL}, r AS (SELECT memory_id, project_id || '/' || memory_id % 40 AS path FROM memories), g AS (SELECT DISTINCT path FROM r WHERE memory_id % 5 = 0), i AS (SELECT memory_id FROM r WHERE path IN (FROM g))
SELECT 'records' AS name, count(*) AS n FROM r WHERE path NOT IN (FROM g) UNION ALL SELECT 'chunks', count(*) FROM r WHERE path NOT IN (FROM g)
UNION ALL SELECT 'relations', count(*) FROM r WHERE memory_id NOT IN (FROM i) AND memory_id + 1 NOT IN (FROM i) UNION ALL SELECT 'erased', count(*) FROM i""",
    "memory_neighbourhood": f"""WITH RECURSIVE {RECORDS_SQL}, r AS (SELECT memory_id, updated_at FROM memories WHERE memory_id % 9 <> 5),
e AS (SELECT memory_id AS src, unnest([memory_id + 7, memory_id * 2]) AS dst FROM r), l AS (SELECT src, dst FROM e WHERE src <> dst AND dst IN (SELECT memory_id FROM r)), b AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l),
w(id, d) AS (SELECT memory_id, 0 FROM r WHERE memory_id IN (3, 10, 100) UNION SELECT b.dst, d + 1 FROM w JOIN b ON b.src = w.id WHERE d < 2),
k AS (SELECT memory_id FROM r WHERE memory_id IN (SELECT id FROM w) ORDER BY updated_at DESC, memory_id LIMIT 30)
SELECT memory_id AS src, -1 AS dst FROM k UNION ALL SELECT src, dst FROM l WHERE src IN (FROM k) AND dst IN (FROM k)""",
    "graph_scores": f"SELECT a.id, round(25 * a.rank + 10 * b.centrality, 6) AS graph_score FROM ({knowledge.ORACLES['pagerank_20']}) a JOIN ({knowledge.ORACLES['degree_centrality']}) b ON a.id = b.id",
    "kinds_and_layers": f"""WITH {RECORDS_SQL} SELECT memory_id, array_to_string(list_filter([CASE WHEN tenant_id <> 'en' THEN 'scope mismatch' END, CASE WHEN memory_id % 3 = 1 THEN 'kind filtered' END,
  CASE WHEN memory_id % 4 IN (1, 3) THEN 'memory layer filtered' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM memories""",
    "inspected_records": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts + to_microseconds(event_id) DESC) AS k FROM events)
SELECT user_id AS memory_id, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY k) FILTER (event_type = 'purchase' AND k <= 2), '') AS purchases,
  coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY k) FILTER (event_type = 'error' AND k <= 2), '') AS errors FROM e GROUP BY 1""",
    "maintenance_selectors": f"""WITH g AS (
  SELECT list_sort(list(DISTINCT doc_id::VARCHAR)) AS ids, list_sort(list(DISTINCT source)) AS paths FROM documents GROUP BY sha256(text) HAVING count(DISTINCT doc_id) > 1
) SELECT array_to_string(ids[1:32], ',') AS memory_ids, array_to_string(paths[1:32], ',') AS paths FROM g ORDER BY sha256('{U.ISSUE_KINDS[0]}|' || array_to_string(ids, ',') || '|' || array_to_string(paths, ',')) LIMIT 1""",
    "synced_ledger": f"""WITH {LEDGER_SQL}, k AS (SELECT id, created_at, prior, CASE WHEN id % 50 = 0 THEN 'retracted' ELSE status END AS status FROM ledger WHERE user_id % 10 <> 3), s AS (SELECT prior AS id, min(created_at) AS e FROM k GROUP BY 1)
SELECT id, status, strftime(e, '%Y-%m-%d %H:%M:%S') AS valid_to FROM k LEFT JOIN s USING (id)""",
}

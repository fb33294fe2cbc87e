"""Queries: discovery of files, chunks of code and what is recorded of them.

The source files are written from the tables: one for each customer with a class of a method an
order, one for each nation, and tests of every fifth customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import code_chunks as K
from ..operators.ledger import saved
from ..sources import ignore
from ..sources import repository as Y
from ..sources.projections import table


#: Bytes of a method's text, about.
METHOD_BYTES = 110


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    key, order = F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")
    method = text("  order", order, "(priority: string): number {\n    if (priority === \"}\") { return 0 } // {\n    return ", F.col("o_orderstatus"), ";\n  }\n")
    orders, people = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    # By as many keys a task as make its share of text: few bytes of shuffle, as these texts are alike, would make few large tasks or a broadcast.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() * METHOD_BYTES // K.TASK_BYTES))
    methods = orders.repartition(tasks, "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", method.alias("t")))), lambda x: x["t"]), "").alias("body")
    )
    customers = people.repartition(tasks, "c_custkey").join(methods.hint("merge"), "c_custkey", "left").withColumn("body", F.coalesce("body", F.lit("")))
    own = customers.select(
        text("src/c", key, ".ts").alias("path"),
        text('import { N } from "./n', F.col("c_nationkey").cast("string"), '";\n\n/** Customer ', F.col("c_name"), ". */\nexport class C", key, " {\n", F.col("body"), "}\n\nexport function total", key,
             "() {\n  return 1;\n}\n\ntype T", key, " = string;\n").alias("content"),
    )
    tests = people.where("c_custkey % 5 = 0").select(
        text("src/c", key, ".test.ts").alias("path"), text('import { total } from "./c', key, '";\nfunction total', key, "() {\n}\n").alias("content")
    )
    nations = table(spark, sf_dir, "nation").select(
        text("src/n", F.col("n_nationkey").cast("string"), ".ts").alias("path"), text("export interface N", F.col("n_nationkey").cast("string"), " {\n}\n").alias("content")
    )
    out = own.unionByName(tests).unionByName(nations)
    return out.withColumns({"language": Y.language(F.col("path")), "sha256": F.sha2("content", 256), "size_bytes": F.octet_length("content").cast("long")})


def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the files are looked at under the rules of two ignore files and a bound."""
    files = _files(spark, sf_dir).select("path", "size_bytes", "content")
    rules = [(".gitignore", "*.test.ts\nn?.ts\n!n2.ts\n"), ("src/.gitignore", "# a few\n/c*7.ts\n!c1*.test.ts\n"), ("src/.env", "X=1"), ("src/a.key", "k"), ("dist/c1.ts", "")]
    more = spark.createDataFrame(rules, "path string, content string").withColumn("size_bytes", F.octet_length("content").cast("long"))
    return ignore.discovered(files.unionByName(more), exclude=["dist/**"], most_bytes=2000).select("path")


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, sf_dir)
    return files, saved(K.chunks(files))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _chunks(spark, sf_dir)
    return found.select("path", "kind", F.coalesce("name", F.lit("")).alias("name"), "start_line", "end_line", F.coalesce("parent_symbol", F.lit("")).alias("parent_symbol"),
                        "exported", F.coalesce("docstring", F.lit("")).alias("docstring"), F.octet_length("content").alias("n_bytes"))


def code_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = _chunks(spark, sf_dir)
    named = Y.imports(files).groupBy("path").agg(F.array_sort(F.collect_set("specifier")).alias("imports"))
    files = files.join(named, "path", "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))
    rows = K.chunk_records(found, files)
    return rows.select("kind", "title", F.array_join("entity_keys", " ").alias("entity_keys"), F.array_join("tags", " ").alias("tags"), "end_line",
                       F.when(F.col("kind") == "artifact", F.col("content")).otherwise("").alias("content"), F.length("identity").alias("n_identity"))


def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _chunks(spark, sf_dir)
    return K.entities(found).select("canonical_name", "entity_type", F.array_join("aliases", " ").alias("aliases"))


def code_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that aren't known yet: those of every eleventh customer's file are."""
    files, found = _chunks(spark, sf_dir)
    links = Y.resolved_imports(Y.imports(files), files)
    everything = saved(K.relations(found, links))
    number = F.regexp_extract("src", r"^src/c(\d+)\.ts::", 1)
    known = everything.where((number != "") & (F.when(number != "", number.cast("long")) % 11 == 0))
    return K.relations(found, links, known)


QUERIES = {f.__name__: f for f in (discovered_files, code_chunks, code_records, code_entities, code_relations)}

_CODE = """o AS (
  SELECT o_custkey AS k, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders
), c AS (
  SELECT c_custkey AS k, c_nationkey, c_name, count(o_orderkey) AS n, coalesce(sum(strlen(o_orderkey::VARCHAR)), 0) AS digits FROM customer LEFT JOIN o ON o.k = c_custkey GROUP BY ALL
), chunk AS (
  SELECT 'src/c' || k || '.ts' AS path, 'method' AS kind, 'order' || o_orderkey AS name, 5 + 4 * (i - 1) AS start_line, 8 + 4 * (i - 1) AS end_line, 'C' || k AS parent_symbol, false AS exported, '' AS docstring,
         97 + strlen(o_orderkey::VARCHAR) AS n_bytes FROM o JOIN c USING (k)
  UNION ALL SELECT 'src/c' || k || '.ts', 'class', 'C' || k, 4, 5 + 4 * n, '', true, 'Customer ' || c_name || '.', 18 + strlen(k::VARCHAR) + 98 * n + digits FROM c
  UNION ALL SELECT 'src/c' || k || '.ts', 'function', 'total' || k, 7 + 4 * n, 9 + 4 * n, '', true, '', 39 + strlen(k::VARCHAR) FROM c
  UNION ALL SELECT 'src/c' || k || '.ts', 'type_alias', 'T' || k, 11 + 4 * n, 11 + 4 * n, '', false, '', 16 + strlen(k::VARCHAR) FROM c
  UNION ALL SELECT 'src/c' || k || '.ts', 'import', '', 1, 1, '', false, '', 24 + strlen(c_nationkey::VARCHAR) FROM c
  UNION ALL SELECT 'src/c' || k || '.ts', 'module', 'c' || k, 1, 12 + 4 * n, '', false, '', 122 + strlen(c_nationkey::VARCHAR) + strlen(c_name) + 3 * strlen(k::VARCHAR) + 98 * n + digits FROM c
  UNION ALL SELECT 'src/c' || k || '.test.ts', 'import', '', 1, 1, '', false, '', 28 + strlen(k::VARCHAR) FROM c WHERE k % 5 = 0
  UNION ALL SELECT 'src/c' || k || '.test.ts', 'function', 'total' || k, 2, 3, '', false, '', 20 + strlen(k::VARCHAR) FROM c WHERE k % 5 = 0
  UNION ALL SELECT 'src/c' || k || '.test.ts', 'module', 'c' || k || '.test', 1, 4, '', false, '', 50 + 2 * strlen(k::VARCHAR) FROM c WHERE k % 5 = 0
  UNION ALL SELECT 'src/n' || n_nationkey || '.ts', 'interface', 'N' || n_nationkey, 1, 2, '', true, '', 22 + strlen(n_nationkey::VARCHAR) FROM nation
  UNION ALL SELECT 'src/n' || n_nationkey || '.ts', 'module', 'n' || n_nationkey, 1, 3, '', false, '', 23 + strlen(n_nationkey::VARCHAR) FROM nation
), keyed AS (SELECT *, path || '::' || CASE WHEN parent_symbol <> '' THEN parent_symbol || '.' ELSE '' END || CASE name WHEN '' THEN kind ELSE name END AS title FROM chunk)"""

ORACLES = {
    "discovered_files": f"""WITH {_CODE}, f AS (SELECT path, max(n_bytes) AS b FROM chunk GROUP BY 1)
SELECT path FROM f WHERE b <= 2000 AND NOT (path LIKE '%.test.ts' AND path NOT LIKE 'src/c1%') AND NOT (regexp_matches(path, '^src/n[0-9].ts$') AND path <> 'src/n2.ts') AND NOT regexp_matches(path, '^src/c[^/]*7.ts$')
UNION ALL SELECT unnest(['.gitignore', 'src/.gitignore'])""",
    "code_chunks": f"WITH {_CODE} SELECT path, kind, name, start_line::INT AS start_line, end_line::INT AS end_line, parent_symbol, exported, docstring, n_bytes::INT AS n_bytes FROM chunk",
    "code_records": f"""WITH {_CODE}, e AS (
  SELECT path, max(end_line) AS end_line, string_agg(name, ', ' ORDER BY start_line) FILTER (exported) AS names FROM chunk GROUP BY 1
), i AS (SELECT 'src/c' || k || '.ts' AS path, './n' || c_nationkey AS spec FROM c UNION ALL SELECT 'src/c' || k || '.test.ts', './c' || k FROM c WHERE k % 5 = 0)
SELECT 'fact' AS kind, title, CASE WHEN parent_symbol <> '' THEN parent_symbol || '.' || name || ' ' ELSE '' END || CASE WHEN name <> '' THEN name || ' ' ELSE '' END || 'file:' || path AS entity_keys,
  'typescript ' || kind || ' indexed' AS tags, end_line::INT AS end_line, '' AS content, 64 AS n_identity FROM keyed WHERE kind <> 'module'
UNION ALL SELECT 'artifact', path, 'file:' || path, 'typescript module indexed', end_line, 'Directory: src' || chr(10) || 'File: ' || path || coalesce(chr(10) || 'Imports: ' || spec, '') || chr(10) || coalesce('Exports: ' || names, 'Summary: indexed module'), 64
FROM e LEFT JOIN i USING (path)""",
    "code_entities": f"""WITH {_CODE} SELECT DISTINCT 'file:' || path AS canonical_name, 'file' AS entity_type, path AS aliases FROM chunk
UNION ALL SELECT title, 'module', name || ' ' || path FROM keyed WHERE kind = 'module'
UNION ALL SELECT title, CASE kind WHEN 'method' THEN 'function' ELSE kind END, name || CASE WHEN exported THEN ' export:' || name ELSE '' END || CASE WHEN parent_symbol <> '' THEN ' ' || parent_symbol || '.' || name ELSE '' END
FROM keyed WHERE kind NOT IN ('module', 'import')""",
    "code_relations": f"""WITH {_CODE}, r AS (
  SELECT title AS src, 'defined_in' AS relation, path AS dst FROM keyed WHERE kind <> 'module'
  UNION ALL SELECT title, 'related_to', path || '::' || parent_symbol FROM keyed WHERE parent_symbol <> ''
  UNION ALL SELECT 'src/c' || k || '.ts::import', 'derived_from', 'src/n' || c_nationkey || '.ts' FROM c
  UNION ALL SELECT 'src/c' || k || '.test.ts::import', 'derived_from', 'src/c' || k || '.ts' FROM c WHERE k % 5 = 0
  UNION ALL SELECT 'src/c' || k || '.test.ts::total' || k, 'supports', 'src/c' || k || '.ts::total' || k FROM c WHERE k % 5 = 0
) SELECT * FROM r WHERE coalesce(try_cast(regexp_extract(src, '^src/c([0-9]+)[.]ts::', 1) AS BIGINT) % 11, 1) <> 0""",
}

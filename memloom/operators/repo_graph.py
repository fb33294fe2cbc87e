"""A typed graph of a source tree: files, folders, symbols, packages, memories, and what joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .observe import ancestors


def node_id(prefix: str, *parts: Column) -> Column:
    """The prefix and 20 hexadecimal digits of the SHA-256 of the parts joined by zero characters."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 20))


def _edge(df: DataFrame, src: Column, dst: Column, kind: str, weight: float = 1.0) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))


def build(files: DataFrame, symbols: DataFrame, imports: DataFrame, packages: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, type, label, path`` and edges ``src, dst, type, weight``.

    ``files(path)``, ``symbols(path, name)``, ``imports(path, target)``, ``packages(path, name,
    dependencies)``, ``memories(id, title, supersedes, sources)`` with sources of ``path,
    symbol``. A memory cites a symbol only if its name occurs once in the file.
    """
    file, folder = lambda c: node_id("file", F.col(c)), lambda c: node_id("dir", F.col(c))
    above = files.select("path", ancestors(F.col("path")).alias("up"))
    folders = above.select(F.explode("up").alias("path")).distinct()
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    once = symbols.groupBy("path", "name").agg(F.count("*").alias("n"))
    symbol = node_id("symbol", F.col("path"), F.col("name"))
    package, memory = node_id("package", F.col("name")), F.concat(F.lit("memory:"), F.col("id"))
    nodes = (
        files.select(file("path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("label"), "path")
        .unionByName(folders.select(folder("path").alias("id"), F.lit("directory").alias("type"), F.col("path").alias("label"), "path"))
        .unionByName(once.select(symbol.alias("id"), F.lit("symbol").alias("type"), F.col("name").alias("label"), "path"))
        .unionByName(packages.select(package.alias("id"), F.lit("package").alias("type"), F.col("name").alias("label"), "path").distinct())
        .unionByName(memories.select(memory.alias("id"), F.lit("memory").alias("type"), F.col("title").alias("label"), F.lit(None).cast("string").alias("path")))
    )
    cited = memories.select("id", F.explode("sources").alias("s")).select("id", "s.path", F.col("s.symbol").alias("name"))
    known = files.select("path")
    depends = packages.select("name", F.explode("dependencies").alias("target")).join(packages.select(F.col("name").alias("target")).distinct(), "target", "left_semi")
    edges = [
        _edge(files.withColumn("parent", parent), folder("parent"), file("path"), "contains"),
        _edge(folders.where("path <> '.'").withColumn("parent", parent), folder("parent"), folder("path"), "contains"),
        _edge(once, file("path"), symbol, "defines"),
        _edge(packages, file("path"), package, "declares"),
        _edge(depends, package, node_id("package", F.col("target")), "depends_on"),
        _edge(imports.where("target IS NOT NULL"), file("path"), file("target"), "imports"),
        _edge(memories.select("id", F.explode("supersedes").alias("old")), memory, F.concat(F.lit("memory:"), F.col("old")), "supersedes"),
        _edge(cited.join(known, "path", "left_semi"), memory, file("path"), "cites"),
        _edge(cited.join(once.where("n = 1"), ["path", "name"], "left_semi"), memory, symbol, "cites"),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return nodes, out.distinct()


def test_relations(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``test_path, path, name``: tests joined by name to the file whose symbols they are about."""
    plain = F.regexp_replace(F.regexp_replace("path", r"\.(test|spec)\.", "."), r"(^|/)test_([^/]*)$", "$1$2")
    tests = files.where(F.col("path").rlike(r"\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*$")).select(F.col("path").alias("test_path"), plain.alias("path"))
    return tests.join(symbols.select("path", "name").distinct(), "path").select("test_path", "path", "name")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``check, n``: repeated node ids, edges without a node at either end, edges to themselves."""
    ids = nodes.select("id")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    return (
        count(ids.groupBy("id").count().where("count > 1"), "repeated id")
        .unionByName(count(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti"), "no source node"))
        .unionByName(count(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), "no target node"))
        .unionByName(count(edges.where("src = dst"), "edge to itself"))
    )


def key_files(files: DataFrame, ranks: DataFrame, degrees: DataFrame, most: int = 18) -> DataFrame:
    """The files that matter most: 10 times the rank, 4 times the centrality, more for manifests and readmes."""
    boost = F.when(F.col("kind") == "manifest", 0.5).when(F.col("kind") == "source", 0.2).otherwise(0.0) + F.when(F.lower("path").rlike("(^|/)readme"), 0.3).otherwise(0.0)
    joined = files.withColumn("id", node_id("file", F.col("path"))).join(ranks, "id", "left").join(degrees.select("id", "centrality"), "id", "left")
    score = 10 * F.coalesce("rank", F.lit(0.0)) + 4 * F.coalesce("centrality", F.lit(0.0)) + boost
    return joined.withColumn("score", score).orderBy(F.desc("score"), F.asc("path")).limit(most).select("path", "score")

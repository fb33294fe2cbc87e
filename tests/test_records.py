import pytest
from pyspark.sql import functions as F

from memloom.operators import records


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_views_and_keys(spark):
    schema = "id string, kind string, status string, supersedes array<string>, sensitivity string, importance double, title string"
    data = [("a", "fact", "active", [], None, 0.1, "z"), ("b", "fact", "active", ["a"], None, 0.5, "y"), ("c", "fact", "active", [], "restricted", 0.9, "x"), ("d", "note", "active", [], None, 1.0, "w")]
    assert [r["id"] for r in records.view(spark.createDataFrame(data, schema), ["fact"]).collect()] == ["b"]
    sources = spark.createDataFrame([([("p", "f"), ("p", None)],)], "s array<struct<path:string,symbol:string>>")
    got = sources.select(records.derived_keys(F.lit("r"), F.lit("x"), F.col("s")).alias("k")).first()["k"]
    assert got == ["file:p", "repo:r", "subject:x", "symbol:p#f"]


def test_relations_and_supersession(spark):
    df = spark.createDataFrame([(1, "t", "active"), (2, "t", "active"), (3, "u", "active"), (4, "t", "active")], "memory_id long, tenant_id string, status string")
    rel = spark.createDataFrame([(1, 2, "r"), (1, 2, "r"), (1, 3, "r"), (1, 9, "r")], "src long, dst long, relation string")
    assert rows(records.related_once(rel, df), "src", "dst") == [(1, 2)]
    changes = spark.createDataFrame([(2, 1), (2, 3), (2, 4)], "memory_id long, supersedes long")
    held = spark.createDataFrame([(4,)], "memory_id long")
    assert rows(records.superseded(df, changes, held), "memory_id", "status") == [(1, "superseded"), (2, "active"), (3, "active"), (4, "active")]
    log = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "memory_id long, created_at long, event string")
    seen = records.inspection(df, {"history": log}, newest=1).where("memory_id = 1").first()
    assert [h["event"] for h in seen["history"]] == ["y"]


def test_lookups_and_graph(spark):
    nodes = spark.createDataFrame([("n1", "file", "a.py", "A"), ("n2", "symbol", "a.py", "f"), ("n3", "file", "b.py", "F")], "id string, type string, path string, label string")
    assert records.resolved_node(nodes, "A.PY") == "n1" and records.resolved_node(nodes, "zz") is None
    with pytest.raises(ValueError):
        records.resolved_node(nodes, "f")
    df = spark.createDataFrame([(str(i),) for i in range(5)], "memory_id string").withColumns(
        {"valid_from": F.lit(None).cast("timestamp_ntz"), "updated_at": F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("memory_id").cast("int"))}
    )
    rel = spark.createDataFrame([("0", "1"), ("2", "1"), ("2", "9"), ("9", "3")], "src string, dst string")
    found, among = records.memory_graph(df, rel, df.where("memory_id = '0'"), 3, 2)
    assert [r["memory_id"] for r in found.collect()] == ["2", "1"] and rows(among, "src", "dst") == [("2", "1")]
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert [r["path"] for r in records.dirty_paths(paths("b", "a"), paths("a")).collect()] == ["a", "b"]
    kept = spark.createDataFrame([("t", "p", "old", "2024-01-01 00:00:00"), ("t", "q", "new", "2024-01-01 00:09:00")], "tenant_id string, project_id string, summary string, g string")
    kept = kept.withColumn("generated_at", F.col("g").cast("timestamp_ntz"))
    asked = kept.select("tenant_id", "project_id")
    assert rows(records.overview_or_default(asked, kept, "2024-01-01 00:10:00"), "project_id", "summary") == [("p", "No overview yet."), ("q", "new")]
    left, chunks, rels, ids = records.purged(df.withColumn("path", F.col("memory_id")), paths("0", "1"), rel, paths("1"))
    assert left.count() == 4 and chunks.count() == 1 and rows(rels, "src", "dst") == [("2", "9"), ("9", "3")] and rows(ids, "memory_id") == [("1",)]

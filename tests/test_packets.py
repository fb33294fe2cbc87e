from pyspark.sql import functions as F

from memloom.operators import capture, graph, packet, repo_graph


def test_tokens_and_scores(spark):
    got = spark.range(1).select(packet.tokens(F.lit("The validation of src/auth.ts, cache"))).first()[0]
    assert set(got) >= {"validation", "validat", "src/auth.ts", "cache"} - {"cach"} and "the" not in got
    rows = [("f1", "file", "src/auth.ts", "auth.ts", ""), ("m1", "memory", None, "login rule", "auth uses tokens"), ("x", "file", "z.md", "z", "none")]
    df = spark.createDataFrame(rows, "id string, type string, path string, name string, text string").withColumns({"importance": F.lit(1.0), "confidence": F.lit(1.0), "sensitivity": F.lit(None).cast("string")})
    got = {r["id"]: r["score"] for r in packet.scored(df, "src/auth.ts").collect()}
    assert got["f1"] == 1000 + 45 and got["x"] == 0
    assert {r["id"]: r["score"] for r in packet.scored(df, "login rule").collect()}["m1"] == 800 + 120 + 45
    near = spark.createDataFrame([("f1", 0), ("x", 1)], "id string, depth long")
    lifted = packet.boosted(packet.scored(df, "src/auth.ts"), near)
    assert {r["id"]: r["score"] for r in lifted.collect()}["x"] == 20
    assert {r["id"] for r in packet.visible(lifted).collect()} == {"f1", "x"}
    hidden = packet.visible(lifted.withColumn("sensitivity", F.lit("restricted")))
    assert hidden.count() == 0


def test_packet_is_cut_at_whole_characters(spark):
    rows = [("g", "a", "file", "p", "a", "é" * 40, 1, 5.0), ("g", "b", "file", "p", "b", "x", 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, id string, type string, path string, name string, text string, exact int, score double")
    for most in (30, 31, 400):
        r = packet.packed(df, ["g"], most, 1000).first()
        assert len(r["packet"].encode()) <= most and "�" not in r["packet"] and r["n_items"] == (2 if most == 400 else 1)


def test_repository_graph(spark):
    files = spark.createDataFrame([("a/b.ts", "source"), ("a/b.test.ts", "test"), ("README.md", "documentation")], "path string, kind string")
    symbols = spark.createDataFrame([("a/b.ts", "f"), ("a/b.ts", "g"), ("a/b.ts", "g")], "path string, name string")
    imports = spark.createDataFrame([("a/b.test.ts", "a/b.ts"), ("a/b.ts", None)], "path string, target string")
    packages = spark.createDataFrame([("package.json", "p", ["q"])], "path string, name string, dependencies array<string>")
    memories = spark.createDataFrame(
        [("m1", "t", [], [("a/b.ts", "f"), ("a/b.ts", "g"), ("gone", None)]), ("m2", "t", ["m1"], [])],
        "id string, title string, supersedes array<string>, sources array<struct<path:string,symbol:string>>",
    )
    nodes, edges = repo_graph.build(files, symbols, imports, packages.where("false"), memories)
    kinds = {r["type"]: r["count"] for r in edges.groupBy("type").count().collect()}
    assert kinds == {"contains": 4, "defines": 2, "imports": 1, "supersedes": 1, "cites": 2}
    assert {r["check"]: r["n"] for r in repo_graph.integrity(nodes, edges).collect()} == {"repeated id": 0, "no source node": 0, "no target node": 0, "edge to itself": 0}
    assert [tuple(r) for r in repo_graph.test_relations(files, symbols).orderBy("name").collect()] == [("a/b.test.ts", "a/b.ts", "f"), ("a/b.test.ts", "a/b.ts", "g")]
    best = repo_graph.key_files(files, graph.pagerank(nodes, edges, 10), graph.degree_centrality(nodes, edges), 2).collect()
    assert best[0]["path"] == "a/b.ts" and len(best) == 2


def test_capture(spark):
    rows = [("p", "s", "c1", "read", 1, "ok", {"path": "x", "content": "secret"}), ("p", "s", "c1", "read", 2, "ok", {"path": "x"}), ("p", "s", "c2", "run", 3, "error", {"command": "ls"})]
    calls = spark.createDataFrame(rows, "provider string, session_id string, call_id string, tool string, ordinal long, status string, arguments map<string,string>")
    found = capture.bounded(capture.observations(calls))
    assert tuple(capture.summary(found).first())[2:] == (2, 1, 1, 1)
    blobs = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new")], "path string, ordinal long, blob string")
    assert tuple(capture.draft_sources(found, blobs, spark.createDataFrame([("x", "newer")], "path string, blob string")).first()) == ("x", "new", True)
    assert found.where("arguments['content'] IS NOT NULL").count() == 0

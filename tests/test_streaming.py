from pyspark.sql import functions as F

from memloom.sources import ledger_files, repository
from memloom.streaming import debounce, limiter, sync


def test_replayed_ledger_changes_nothing(spark, tmp_path):
    schema = "id long, created_at timestamp, status string, supersedes array<long>"
    rows = [(1, "2024-01-02", "active", []), (2, "2024-01-03", "active", [1])]
    make = lambda r: spark.createDataFrame(r, "id long, t string, status string, supersedes array<long>").select("id", F.to_timestamp("t").alias("created_at"), "status", "supersedes")
    make(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: sync.sync(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "out/version=0"))
    assert {(r["id"], str(r["valid_to"])[:10]) for r in first.collect()} == {(1, "2024-01-03"), (2, "None")}
    # late, repeated and retracting events
    make([(3, "2024-01-01", "active", []), (2, "2024-01-03", "retracted", [1])]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    last = spark.read.parquet(str(tmp_path / "out/version=1"))
    assert {(r["id"], r["status"]) for r in last.collect()} == {(1, "active"), (2, "retracted"), (3, "active")}


def test_bucket_over_stored_events_and_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:0{i}", i) for i in range(5)] + [("b", "2024-01-01 00:00:00", 9)]
    df = spark.createDataFrame(rows, "key string, t string, id long").select("key", F.col("t").cast("timestamp_ntz").alias("at"), "id")
    want = {(0, True), (1, True), (2, True), (3, False), (4, True), (9, True)}
    stored = limiter.limited(df, "key", "at", "id", rate=0.5, burst=2)
    assert {(r["id"], r["allowed"]) for r in stored.collect()} == want
    assert streamed(spark, tmp_path, [rows], "1 hour")[0] == want


def streamed(spark, tmp_path, batches, lateness):
    """Decisions of the stream over batches, and how many keys its state holds at the end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "key string, at timestamp, id long"
    name = f"bucket{len(batches)}"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "key string, t string, id long").select("key", F.to_timestamp("t").alias("at"), "id")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = limiter.limited_stream(stream, 0.5, 2.0, lateness).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
        query = out.outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    found = {(r["id"], r["allowed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    held = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    return found, held[-1]


def test_idle_keys_leave_the_state_of_the_stream(spark, tmp_path):
    early = [(f"k{i}", "2024-01-01 00:00:00", i) for i in range(20)]
    late = [("a", "2024-01-01 01:00:00", 100), ("k0", "2024-01-01 01:00:01", 101)]
    last = [("k0", "2024-01-01 01:00:01", 102), ("k0", "2024-01-01 01:00:01", 103), ("k1", "2024-01-01 01:00:02", 104)]
    found, held = streamed(spark, tmp_path, [early, late, last], "10 seconds")
    stored = spark.createDataFrame(early + late + last, "key string, t string, id long").select("key", F.col("t").cast("timestamp_ntz").alias("at"), "id")
    assert found == {(r["id"], r["allowed"]) for r in limiter.limited(stored, "key", "at", "id", rate=0.5, burst=2).collect()}
    assert (103, False) in found and held < 15


def test_sessions_end_after_a_gap(spark):
    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:09", "a"), (1, "2024-01-01 00:00:20", "b")]
    df = spark.createDataFrame(rows, "u long, t string, p string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = debounce.sessions(df, ["u"], "t", "p", 10)
    assert sorted((r["n_changes"], r["n_paths"]) for r in got.collect()) == [(1, 1), (2, 1)]


def test_repository_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/auth.ts").write_text('import { T } from "./types";\r\nexport function login() { return process.env.API_URL }\n')
    (tmp_path / "src/types.ts").write_text("export interface T {}\n")
    (tmp_path / "src/auth.test.ts").write_text('import { login } from "./auth";\n')
    (tmp_path / ".env").write_text("X=1")
    (tmp_path / "package.json").write_text('{"name": "x", "scripts": {"test": "t"}, "devDependencies": {"d": "1"}}')
    (tmp_path / "blob.bin").write_bytes(b"\x00\x01")
    files = repository.scan(spark, str(tmp_path)).cache()
    kinds = {r["path"]: r["kind"] for r in files.collect()}
    assert kinds == {"src/auth.ts": "source", "src/types.ts": "source", "src/auth.test.ts": "test", "package.json": "manifest"}
    targets = {(r["path"], r["target"]) for r in repository.resolved_imports(repository.imports(files), files).collect()}
    assert targets == {("src/auth.ts", "src/types.ts"), ("src/auth.test.ts", "src/auth.ts")}
    assert {(r["name"], r["line"]) for r in repository.symbols(files).collect()} == {("login", 2), ("T", 1)}
    assert [r["name"] for r in repository.environment_variables(files).collect()] == ["API_URL"]
    manifest = repository.package_manifests(files).first()
    assert manifest["name"] == "x" and manifest["dependencies"] == ["d"] and manifest["commands"] == ["test"]
    folder = ledger_files.commit_generation({"files": files.drop("content")}, str(tmp_path / "out"), 1)
    assert spark.read.json(f"{folder}/manifest").count() == 1

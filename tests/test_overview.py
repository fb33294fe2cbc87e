"""Overviews, writes and procedures on small and awkward tables."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import code_chunks, context, graph, ledger, lifecycle, overview, procedures, triggers, writes
from memloom.streaming import sync

RECORDS = "memory_id long, tenant_id string, status string, held boolean, memory_layer string, embedding array<float>"


def test_storage_of_tenants_without_records(spark):
    rows = spark.createDataFrame([(1, "a", "active", True, "user", [1.0]), (2, "a", None, None, None, None)], RECORDS)
    links = spark.createDataFrame([(1,), (1,), (9,)], "memory_id long")
    other = spark.createDataFrame([("b",)], "tenant_id string")
    got = {r["tenant_id"]: r.asDict() for r in overview.storage_overview(rows, {"relations": links, "connectors": other}, {"models": other}).collect()}
    assert got["a"]["memories_total"] == 2 and got["a"]["memories_active"] == 1 and got["a"]["memories_held"] == 1 and got["a"]["vectorized_memories"] == 1
    assert got["a"]["relations_total"] == 2 and got["b"]["memories_total"] == 0 and got["b"]["connectors_total"] == 1 and got["b"]["models_total"] == 1
    assert not overview.storage_overview(rows.limit(0), {}).count()


def test_erasure_keeps_what_is_held_and_repeats(spark):
    rows = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v"), (4, None)], "memory_id long, user_id string")
    links = spark.createDataFrame([(1, 3), (3, 4), (2, 3)], "src long, dst long")
    holds = (lifecycle.Hold("case", ids=(2,)),)
    asked = spark.createDataFrame([("u",), ("w",)], "user_id string")
    once = lifecycle.forgotten(rows, {"links": links}, holds, "2024-01-01", "user_id", asked)
    assert {r["memory_id"] for r in once["records"].collect()} == {2, 3, 4}
    assert {tuple(r) for r in once["links"].collect()} == {(3, 4), (2, 3)}
    assert {r["user_id"]: (r["n_erased"], r["n_held"]) for r in once["events"].collect()} == {"u": (1, 1), "w": (0, 0)}
    again = lifecycle.forgotten(once["records"], {"links": once["links"]}, holds, "2024-01-01", "user_id", asked)
    assert again["erased"].count() == 0 and again["records"].count() == 3


def test_selectors_need_a_level():
    for bad in ({}, {"user_id": None}, {"team": "x"}):
        with pytest.raises(ValueError):
            writes.erase_selector("t", **bad)
    with pytest.raises(ValueError):
        writes.erase_selector("", user_id="u")


def test_guarded_merge(spark):
    schema = "id long, tenant_id string, v string, at long"
    now = spark.createDataFrame([(1, "a", "old", 1)], schema)
    new = spark.createDataFrame([(1, "b", "theirs", 5), (1, "a", "new", 3), (2, "c", "x", 1), (2, "d", "y", 2), (3, None, "z", 1)], schema)
    merged, refused = writes.guarded_upsert(now, new, ["id"], "at")
    assert {(r["id"], r["tenant_id"], r["v"]) for r in merged.collect()} == {(1, "a", "new"), (2, "c", "x")}
    assert {(r["id"], r["tenant_id"]) for r in refused.collect()} == {(1, "b"), (2, "d"), (3, None)}


def test_procedures_are_written_once(spark):
    schema = "request_id long, receipt_id string, title string, steps array<string>, path string, start_line int, end_line int, authority string, sensitivity string, created_at long"
    make = lambda i, receipt, title="t", path="a", end=2, at=1: (i, receipt, title, ["s"], path, 1, end, "agent", "public", at)
    files = spark.createDataFrame([("a", 3)], "path string, lines int")
    none = spark.createDataFrame([], "receipt_id string, digest string")
    drafts = spark.createDataFrame([make(1, "r"), make(2, "r"), make(3, "r", "other"), make(4, "q", path="b"), make(5, "p", end=4), make(6, "o", end=0)], schema)
    first = procedures.learned(drafts, none, files)
    assert {r["request_id"]: r["verdict"] for r in first.collect()} == {1: "written", 2: "known", 3: "receipt was used", 4: "no such source", 5: "lines beyond the source", 6: "lines out of order"}
    again = procedures.learned(drafts, first.where("verdict = 'written'").select("receipt_id", "digest"), files)
    assert {r["request_id"]: r["verdict"] for r in again.collect()}[1] == "known"
    targets = spark.createDataFrame([("x", "candidate", True, "a", "h"), ("y", "candidate", True, "a", None)], "id string, state string, active boolean, path string, blob string")
    asked = spark.createDataFrame([(1, "k", "x", "human", 1), (2, "l", "x", "human", 2), (3, "m", "y", "human", 1), (4, "n", "z", "human", 1), (5, "o", "x", "agent", 0)], "request_id long, receipt_id string, procedure_id string, authority string, created_at long")
    got = procedures.approved(asked, targets, spark.createDataFrame([("a", "h")], "path string, sha256 string"), none)
    assert {r["request_id"]: r["verdict"] for r in got.collect()} == {1: "written", 2: "approved before", 3: "source has changed", 4: "no such procedure", 5: "needs human authority"}


def test_partition_of_repeated_rows(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = {r["id"]: r["problem"] for r in ledger.partition_errors(ids(1, 2, 3, 3, 4), ids(1, 3, 3), ids(1, 5)).collect()}
    assert got == {1: "kept and omitted", 2: "lost", 4: "lost", 5: "not supplied"}


def test_graph_at_a_time(spark):
    nodes = spark.createDataFrame([("a", None, None), ("b", "2024-01-02", None), ("c", None, "2024-01-02")], "id string, f string, t string")
    nodes = nodes.select("id", F.col("f").cast("timestamp_ntz").alias("valid_from"), F.col("t").cast("timestamp_ntz").alias("valid_to"))
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    at = lambda t: {tuple(r) for r in graph.induced_at(nodes, edges, t)[1].select("src", "dst").collect()}
    assert at("2024-01-01 00:00:00") == {("a", "c")} and at("2024-01-02 00:00:00") == {("a", "b")}


def test_tombstones_of_known_events_are_not_a_no_op(spark):
    rows = spark.createDataFrame([(1, "active"), (2, "active")], "id long, status string")
    assert sync.is_no_op(rows, rows) and not sync.is_no_op(rows, rows, rows.limit(1).select("id"))
    assert sync.is_no_op(rows, rows, spark.createDataFrame([(9,)], "id long"))


def test_short_phrases_are_found_in_texts(spark):
    side = lambda name, *texts: spark.createDataFrame([("t", x) for x in texts], f"tenant_id string, {name} string")
    got = {(r["short"], r["long"]) for r in triggers.contained(side("short", "a", "ab", "abc", "zz", "bcd"), side("long", "xabcx", "b", "aab")).collect()}
    assert got == {("a", "xabcx"), ("ab", "xabcx"), ("abc", "xabcx"), ("a", "aab"), ("ab", "aab")}


@pytest.mark.parametrize("find", ["contained", "containing"])
def test_contained_texts_equal_a_plain_search(spark, monkeypatch, find):
    """By runs and by substrings, with texts longer than are cut into substrings, repeats within a text, and two tenants."""
    rng = random.Random(5)
    text = lambda most: "".join(rng.choice("ab c") for _ in range(rng.randint(1, most)))
    short = {(t, text(6)) for t in "xy" for _ in range(40)}
    long = {(t, text(30)) for t in "xy" for _ in range(30)} | {("x", "abc" * 30), ("y", "\U0001f600" + "c a" * 25)}
    monkeypatch.setattr(triggers, "SUBSTRINGS_OF", 20)
    side = lambda name, rows: spark.createDataFrame(sorted(rows), f"tenant_id string, {name} string")
    got = [tuple(r) for r in getattr(triggers, find)(side("short", short), side("long", long)).collect()]
    assert sorted(got) == sorted((t, a, b) for t, a in short for u, b in long if t == u and a in b)


def test_routes_without_a_model(spark):
    asked = spark.createDataFrame([("1", "t", "fast"), ("2", "none", "fast"), ("3", "t", "powerful")], "request_id string, task string, tier string")
    models = spark.createDataFrame([("m", "balanced", 1.0, ["t"]), ("n", "balanced", 0.5, ["t"]), ("o", "fast", 9.0, ["t"])], "model string, tier string, cost double, tasks array<string>")
    assert {r["request_id"]: r["model"] for r in context.model_routes(asked, models).collect()} == {"1": "o", "2": None, "3": "n"}


def test_briefs_of_bare_repositories(spark):
    rows = spark.createDataFrame([("r", None, 0, 0, 0, 0, [], 0)], "repository string, description string, files long, symbols long, nodes long, edges long, languages array<string>, active long")
    empty = lambda schema: spark.createDataFrame([], "repository string, " + schema)
    brief = overview.boot_briefs(rows, empty("directory string, file_count long"), empty("path string, name string, ecosystem string, n_dependencies long"), empty("command string, cwd string, source string"),
                                 empty("name string, paths array<string>"), empty("path string, score double")).first()
    assert brief["fits"] and "none detected" in brief["brief"] and "_Single-directory repository._" in brief["brief"]
    assert code_chunks.entities(code_chunks.chunks(spark.createDataFrame([], "path string, language string, content string"))).count() == 0

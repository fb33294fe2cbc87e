"""Operators on small tables with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.functions import vector as V
from memloom.operators import access, context, evaluate, extraction, graph, ledger, lifecycle, observe, retrieval, triggers
from memloom.operators.filters import Request, rejection_reasons, valid_at


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_token_counters(spark):
    assert one(spark, T.word_tokens(F.lit("hello world how are you"))) == 7
    assert one(spark, T.byte_tokens(F.lit("hello"))) == 2
    assert one(spark, T.char_tokens(F.lit(""))) == 1


def test_budget_skips_what_does_not_fit(spark):
    rows = [("q", "a", 100, 0.9, 0.8), ("q", "b", 200, 0.5, 0.3), ("q", "c", 50, 0.7, 0.9)]
    df = spark.createDataFrame(rows, "g string, id string, tokens long, score double, importance double")
    assert values(context.greedy_budget(df, ["g"], 1000, 300, 200), "g", "selected", "used", "remaining") == [("q", "a,c,b", 350, 150)]
    big = spark.createDataFrame([("q", "big", 5000, 1.0, 1.0)], df.schema)
    assert values(context.greedy_budget(big, ["g"], 1000, 500, 400), "selected", "used") == [("", 0)]


def test_budget_tries_candidates_after_the_best(spark):
    sizes = {"q": [90, *[200] * 7, 8, *[50] * 5, 3, 1, 1], None: [40, *[70] * 6, 30, 30, 25], "none": [101]}
    rows = [(g, f"{k:02d}", n, 1 - k / 100, 0.5) for g, tokens in sizes.items() for k, n in enumerate(tokens)]
    df = spark.createDataFrame(rows, "g string, id string, tokens long, score double, importance double")
    got = {r["g"]: (r["selected"], r["used"], r["remaining"]) for r in context.greedy_budget(df, ["g"], 100, candidates_each=2).collect()}
    assert got == {"q": ("00,08,15,16", 100, 0), None: ("00,07,08", 100, 0), "none": ("", 0, 100)}


def test_trigger_scores_and_tenants(spark):
    index = triggers.phrase_index(
        spark.createDataFrame([("a", "Project  Plan", 1), ("a", "roadmap", 2), ("b", "plan", 3)], "tenant_id string, phrase string, memory_id long")
    )
    said = spark.createDataFrame([("a", 1, "tell me about the project plan"), ("b", 2, "roadmap")], "tenant_id string, m long, text string")
    assert values(triggers.lookup(said, index, ["m"], "text"), "m", "phrase", "score") == [(1, "project plan", 1.0)]
    assert triggers.without(index, spark.createDataFrame([(1,)], "memory_id long")).count() == 2


@pytest.fixture
def small_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    return nodes, spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")


def test_graph(small_graph):
    nodes, edges = small_graph
    assert values(graph.weak_components(nodes, edges), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert graph.shortest_path(nodes, edges, "a", "c", "out") == ["a", "b", "c"]
    assert graph.shortest_path(nodes, edges, "c", "a", "out") is None
    assert graph.shortest_path(nodes, edges, "c", "a", "both") == ["c", "b", "a"]
    assert graph.shortest_path(nodes, edges, "a", "a", "both") == ["a"]
    assert graph.shortest_path(nodes, edges, "a", "z", "both") is None
    near, touched = graph.neighbourhood(nodes, edges, "a", 1, "out")
    assert values(near, "id") == [("a",), ("b",)] and values(touched, "src", "dst") == [("a", "b")]
    degree = dict(values(graph.degree_centrality(nodes, edges), "id", "centrality"))
    assert degree["b"] == pytest.approx(2 / 3) and degree["d"] == 0
    ranks = dict(values(graph.pagerank(nodes, edges, 100, tolerance=1e-10), "id", "rank"))
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] > ranks["a"]


def test_validity_end_is_inclusive_and_expiry_exclusive(spark):
    t = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    assert one(spark, valid_at(t(5), t(5), t(5), t(6)))
    assert not one(spark, valid_at(t(5), none, none, t(5)))
    assert not one(spark, valid_at(t(5), t(6), none, none))
    assert one(spark, valid_at(t(5), none, none, none))


def test_all_reasons_are_listed(spark):
    df = spark.createDataFrame([("t", "p", ["x"], "deleted"), ("u", None, [], "active")], "tenant_id string, project_id string, tags array<string>, status string")
    request = Request(tenant_id="t", scope={"project_id": "p"}, tags=("x", "y"))
    assert values(df.select(F.array_join(rejection_reasons(df, request), "; ").alias("r")), "r") == [("missing tags: y; deleted",), ("scope mismatch; missing tags: x, y",)]


def test_access(spark):
    acl = "array<struct<principal_id:string,principal_type:string,permissions:array<string>>>"
    rows = [(1, "t", []), (2, "t", [("ann", "user", ["read"])]), (3, "t", [("crew", "group", ["admin"])]), (4, "u", [])]
    df = spark.createDataFrame(rows, f"id long, tenant_id string, acl {acl}")
    seen = lambda c, p="read": [r[0] for r in values(df.where(access.can_access(c, p)), "id")]
    assert seen(access.Caller("ann", "t")) == [1, 2]
    assert seen(access.Caller("ann", "t"), "write") == [1]
    assert seen(access.Caller("bob", "t", groups=("crew",))) == [1, 3]
    assert seen(access.Caller("x", "t", role="admin")) == [1, 2, 3]
    assert seen(access.Caller("x", role="superadmin")) == [1, 2, 3, 4]
    assert seen(access.Caller("x", role="superadmin", bound_scope={"tenant_id": "u"})) == [4]


def test_every_source_needs_a_grant(spark):
    sources = spark.createDataFrame([(1, "s1"), (1, "s2"), (2, "s1")], "memory_id long, source_id string")
    grants = spark.createDataFrame([("s1", "p", "view"), ("s2", "q", "owner")], "source_id string, principal_id string, permission_level string")
    assert values(access.source_grants(sources, grants, ["p"]), "memory_id", "allowed") == [(1, False), (2, True)]
    assert values(access.source_grants(sources, grants, ["p", "q"]), "memory_id", "allowed") == [(1, True), (2, True)]
    users = spark.createDataFrame([("viewer",), ("nobody",)], "role string")
    assert values(access.role_permissions(users), "role", F.size("permissions")) == [("nobody", 0), ("viewer", 1)]


def test_fusion_and_bonuses(spark):
    assert one(spark, retrieval.fused(F.lit(0.5), F.lit(0.4))) == pytest.approx(0.55 * 0.5 + 0.45 * 0.4)
    assert one(spark, retrieval.fused(F.lit(0.0), F.lit(0.4))) == 0.4
    assert one(spark, retrieval.feedback_net(F.lit(10), F.lit(1), F.lit(0), F.lit(0))) == pytest.approx(0.45)
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, retrieval.citation(F.lit("doc"), F.lit("7"), F.lit("T"), F.lit(None).cast("string"))) == "doc:7 (T)"
    assert one(spark, retrieval.inferred_layer(F.lit(None), F.lit("a"), F.lit(None))) == "agent"
    e = one(spark, V.pseudo_embedding(F.lit("x"), 12))
    assert len(e) == 12 and sum(x * x for x in e) == pytest.approx(1)


def test_vector_basis_fixture(spark):
    rows = [("alpha", [1.0, 0.0, 0.0]), ("bravo", [0.0, 1.0, 0.0]), ("charlie", [0.9, 0.1, 0.0]), ("short", [1.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = retrieval.top(retrieval.neighbours(df, [1.0, 0.0, 0.0], ["id"]), 2, F.desc("similarity"), F.asc("id")).collect()
    assert [r["id"] for r in got] == ["alpha", "charlie"]


def test_exact_session_scope_ranks_first(spark):
    rows = [("a", "acme", None, None), ("b", "acme", "pm-1", "session-7")]
    df = spark.createDataFrame(rows, "memory_id string, tenant_id string, user_id string, session_id string").selectExpr(
        "*", "'LinkedIn trust policy' AS title", "'evidence automation' AS content", "array() AS tags", "array() AS entity_keys",
        "0.5D AS importance", "timestamp_ntz'2024-01-31' AS updated_at", "CASE WHEN session_id IS NULL THEN 'organization' ELSE 'session' END AS memory_layer",
    ).withColumns({c: F.col(c).cast("array<string>") for c in ("tags", "entity_keys")})
    request = Request("acme", {"user_id": "pm-1", "session_id": "session-7"})
    best = retrieval.scored(df, request, "LinkedIn evidence automation").orderBy(F.desc("score")).first()
    assert best["memory_id"] == "b" and "exact session scope" in best["reasons"]


def test_abstains_below_the_threshold(spark):
    df = spark.createDataFrame([(0.1,), (0.12,)], "combined double")
    assert retrieval.abstaining(df).count() == 0 and retrieval.abstaining(df, least=0.11).count() == 2


@pytest.fixture
def chain(spark):
    rows = [(1, 1, [], "active", "human"), (2, 2, [1], "active", "human"), (3, 3, [2], "retracted", "human"), (4, 1, [], "active", "tool")]
    rows = [(i, f"2024-01-0{d} 00:00:00", s, st, a) for i, d, s, st, a in rows]
    df = spark.createDataFrame(rows, "id long, t string, supersedes array<long>, status string, authority string")
    return df.withColumn("created_at", F.col("t").cast("timestamp_ntz"))


def test_ledger_views(spark, chain):
    assert values(ledger.active_heads(chain), "id") == [(4,)]
    assert values(ledger.heads_as_of(chain, "2024-01-02 00:00:00"), "id") == [(2,), (4,)]
    assert values(ledger.lineage(chain), "id", "root", "depth") == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)]
    ends = values(ledger.intervals(chain), "id", F.date_format("valid_to", "d"))
    assert ends == [(1, "2"), (2, "3"), (3, "3"), (4, None)]
    bad = chain.withColumn("supersedes", F.when(F.col("id") == 4, F.array(F.lit(1).cast("long"), F.lit(4).cast("long"), F.lit(9).cast("long"))).otherwise(F.col("supersedes")))
    assert values(ledger.admission(bad).where("violation IS NOT NULL"), "id", "target", "violation") == [
        (4, 1, "lower authority"), (4, 4, "self reference"), (4, 9, "unknown reference"),
    ]


def test_reconcile_defers_and_protects(spark):
    old = spark.createDataFrame([("a", "1", "tool"), ("b", "1", "human"), ("c", "1", "tool"), ("d", "1", "tool")], "logical_key string, fingerprint string, authority string")
    new = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", "1"), ("e", "1")], "logical_key string, fingerprint string")
    assert values(ledger.reconcile(old, new), "logical_key", "action") == [("a", "SUPERSEDE"), ("b", "CONFLICT"), ("c", "NOOP"), ("d", "RETRACT"), ("e", "ADD")]
    assert ("d", "DEFER") in values(ledger.reconcile(old, new, scan_complete=False), "logical_key", "action")


def test_lifecycle(spark):
    new = spark.createDataFrame([(1, "f", 2), (2, "f", 1), (3, "g", 1), (4, "h", 1)], "memory_id long, fingerprint string, created_at long")
    old = spark.createDataFrame([("g",)], "fingerprint string")
    assert values(lifecycle.created(old, new), "memory_id") == [(2,), (4,)]
    current = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "memory_id long, title string, summary string")
    change = spark.createDataFrame([(1, None, "x", ["title"])], "memory_id long, title string, summary string, set array<string>")
    assert sorted(map(tuple, lifecycle.patched(current, change).collect()), key=str) == [(1, None, "b"), (2, "c", "d")]
    rows = spark.createDataFrame([(1, "active"), (2, "active"), (3, "active")], "memory_id long, status string")
    ids, held = rows.where("memory_id < 3"), rows.where("memory_id = 2")
    assert values(lifecycle.deleted(rows, ids, held), "memory_id", "status") == [(1, "deleted"), (2, "active"), (3, "active")]
    assert values(lifecycle.deleted(rows, ids, held, hard=True), "memory_id") == [(2,), (3,)]
    merged = ledger.upsert(spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, at long, v string"), spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k long, at long, v string"), ["k"], "at")
    assert values(merged, "k", "v") == [(1, "c"), (2, "b"), (3, "e")]


def test_observation(spark):
    assert one(spark, observe.ancestors(F.lit("a/b/c.py"))) == [".", "a", "a/b"]
    late = observe.freshness_deadline(F.lit(None).cast("timestamp_ntz"), F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(0))
    assert one(spark, late) is None


def test_extraction(spark):
    df = spark.createDataFrame([(1, "Short. This one is long enough. THIS ONE IS LONG ENOUGH. tail"), (2, "tiny")], "id long, text string")
    assert values(extraction.facts(df, ["id"], "text"), "id", "place", "fact") == [(1, 0, "This one is long enough."), (2, 0, "tiny")]
    assert one(spark, extraction.names(F.lit("Ada Lovelace met Bob. Ada Lovelace"), F.array(F.lit("k")))) == ["k", "Ada Lovelace"]
    assert one(spark, T.classified(F.lit("We decided"), T.KIND_RULES, "fact")) == "decision"
    assert one(spark, T.pronouns_rewritten(F.lit("i think I'm sure my plan"), "Ada", "Ada's")) == "I think Ada is sure Ada's plan"
    assert one(spark, T.has_credential(F.lit("key ghp_" + "a" * 24))) and not one(spark, T.has_credential(F.lit("the key")))
    new = spark.createDataFrame([("g", 1, "the cat is not here")], "g string, memory_id long, content string")
    old = spark.createDataFrame([("g", 2, "the cat is here."), ("g", 3, "dogs")], "g string, memory_id long, content string")
    assert values(extraction.conflicting(new, old, "g"), "memory_id", "candidate_id") == [(1, 2)]


def test_metrics(spark):
    got = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, item string, place long")
    good = spark.createDataFrame([("q", "b"), ("q", "z")], "query string, item string")
    r = evaluate.retrieval_metrics(got, good, ["query"]).first()
    assert r["precision_5"] == pytest.approx(0.2) and r["recall_5"] == 0.5 and r["mrr"] == 0.5
    assert r["ndcg_10"] == pytest.approx((1 / 1.5849625) / (1 + 1 / 1.5849625))


def test_agent_context_cuts_the_last_block(spark):
    rows = [(1, "fact", "A", "x" * 100, 0.9), (2, "fact", "B", "y" * 500, 0.8), (3, "fact", "C", "z", 0.7)]
    df = spark.createDataFrame(rows, "memory_id long, kind string, title string, content string, score double")
    r = context.agent_context(df, 300).first()
    assert r["n_records"] == 2 and len(r["context"]) == 300 and "z" not in r["context"]


def test_procedures_and_routes(spark):
    p = spark.createDataFrame([(1, True, "a", "a"), (2, True, "a", "b"), (3, False, "a", "a"), (4, True, "a", "a")], "id long, approved boolean, source_hash string, current_hash string")
    r = spark.createDataFrame([(1, "failure", 1), (1, "success", 2)], "procedure_id long, outcome string, position long")
    assert values(context.procedure_states(p, r), "id", "state", "prior") == [(1, "ready", 0.5), (2, "stale", 0.5), (3, "candidate", 0.5), (4, "unverified", 0.5)]


def test_attested_ledger_file(spark, tmp_path):
    from memloom.sources import ledger_files

    lines = [json.dumps({"id": f"e{i}", "kind": "fact", "status": "active", "supersedes": []}, sort_keys=True, separators=(",", ":")) for i in range(3)]
    path = tmp_path / "ledger.jsonl"
    path.write_text("\n".join(lines) + "\n\n{broken\n")
    events, broken = ledger_files.read(spark, str(path))
    assert values(events, "id") == [("e0",), ("e1",), ("e2",)] and broken.count() == 1
    assert ledger_files.attestation(spark, str(path)).count() == 1

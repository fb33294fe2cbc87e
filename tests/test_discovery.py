"""Ignore rules, bounds of scans, strict ledgers, canonical JSON, stems."""

import json
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from memloom.functions.english import STOP_WORDS, stem
from memloom.operators import keyword_index, ledger, retrieval
from memloom.plans import strict
from memloom.sources import ignore, strict_ledger


def files_of(spark, files):
    rows = [(p, len(c), c) for p, c in files.items()]
    return spark.createDataFrame(rows, "path string, size_bytes long, content string")


def test_ignore_rules_along_the_chain(spark):
    files = {
        ".gitignore": "# rules\n*.log\n!keep.log\n/build/\nnode_modules\ndocs/**/draft?.md\n\\#odd\n  \na/b[0-9].txt\n**/tmp\ntrail.txt   \n",
        "src/.gitignore": "!debug.log\n*.gen.ts\n/only\n",
        "lib/.gitignore": "*\n!*.py\n",
        "x.log": "", "keep.log": "", "src/x.log": "", "src/debug.log": "", "src/deep/debug.log": "", "build/out.txt": "", "src/build/out.txt": "", "build": "",
        "node_modules/p/index.js": "", "src/node_modules/q.js": "", "docs/draft1.md": "", "docs/x/y/draft2.md": "", "docs/draft12.md": "", "#odd": "",
        "a/b1.txt": "", "a/bx.txt": "", "c/a/b1.txt": "", "q/tmp/z": "", "tmp": "", "src/one.gen.ts": "", "one.gen.ts": "", "src/only": "", "src/deep/only": "",
        "lib/a.py": "", "lib/a.txt": "", "lib/sub/a.py": "", "trail.txt": "", "build/keep.log": "",
    }
    gone = {r["path"] for r in ignore.ignored(files_of(spark, files).select("path"), ignore.ignore_rules(files_of(spark, files))).collect()}
    assert gone == {
        "x.log", "src/x.log", "build/out.txt", "node_modules/p/index.js", "src/node_modules/q.js", "docs/draft1.md", "docs/x/y/draft2.md", "#odd",
        "a/b1.txt", "q/tmp/z", "tmp", "src/one.gen.ts", "src/only", "lib/a.txt", "lib/sub/a.py", "lib/.gitignore", "trail.txt", "build/keep.log",
    }


def test_discovery_and_bounds(spark):
    files = files_of(spark, {"a.ts": "x" * 10, ".env.local": "", "k/.aws/c": "", "id.PEM": "", "b.ts": "y" * 700, "c/credentials.json": "", "c/d.ts": "z", "c/d.md": ""})
    found = ignore.discovered(files, include=["**/*.ts", "*.md"], exclude=["a.*"], most_bytes=600)
    assert {r["path"] for r in found.collect()} == {"c/d.ts"}
    some = ignore.bounded(files, most_files=3, most_bytes=1000).collect()
    assert [r["path"] for r in some] == [".env.local", "a.ts", "b.ts"] and not some[0]["complete"]
    assert all(r["complete"] for r in ignore.bounded(files).collect()) and ignore.bounded(files).count() == 8
    assert [r["path"] for r in ignore.bounded(files, most_bytes=5).collect()] == [".env.local"]


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (333333333.33333329, "333333333.3333333"), (1e30, "1e+30"), (4.5, "4.5"), (2e-3, "0.002"), (1e-27, "1e-27"), (1e21, "1e+21"), (1e20, "100000000000000000000"),
        (123456789012345680000.0, "123456789012345680000"), (-0.0, "0"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (0.000001, "0.000001"),
        (1e-7, "1e-7"), (-12.5, "-12.5"), (100.0, "100"), (9007199254740991, "9007199254740991"), ("€$\x0f\nA'B\"\\\\\"/", '"€$\\u000f\\nA\'B\\"\\\\\\\\\\"/"'),
        ({"\U0001f600": 1, "\ufb33": 2, "\r": 3, "1": [True, None]}, '{"\\r":3,"1":[true,null],"\U0001f600":1,"\ufb33":2}'),
    ],
)
def test_canonical_json(value, text):
    assert strict_ledger.canonical(value) == text
    assert json.loads(text, parse_int=float) == value


@pytest.mark.parametrize("value", [1 << 53, float("nan"), "\ud800", {"\udfff": 1}, [float("inf")]])
def test_what_cannot_be_canonical(value):
    with pytest.raises(strict_ledger.NotCanonical):
        strict_ledger.canonical(value)


GOOD = {
    "schema_version": 1, "id": "evt-1", "kind": "fact", "subject_type": "repo", "title": "T", "body": "B", "status": "active", "provenance": {"actor": "a", "method": "observed"},
    "authority": "agent", "confidence": 0.5, "importance": 1, "sensitivity": "internal", "created_at": "2024-01-01T00:00:00.000Z", "updated_at": "2024-01-01T00:00:00.000Z",
}


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({}, None), ({"extra": 1}, "invalid extra"), ({"title": ""}, "invalid title"), ({"title": 5}, "invalid title"), ({"importance": True}, "invalid importance"),
        ({"schema_version": True}, "invalid schema_version"), ({"id": "x"}, "invalid id"), ({"provenance": {"actor": "a"}}, "invalid provenance.method"),
        ({"sources": [{"path": "a"}, {"path": "/b"}]}, "invalid sources.1"), ({"sources": [{"path": "a", "start_line": 0}]}, "invalid sources.0.start_line"),
        ({"sources": [{"path": "b"}, {"path": "a"}]}, "invalid event"), ({"tags": ["a", "a"]}, "invalid event"), ({"tags": ["a  b"]}, "invalid event"),
        ({"supersedes": ["evt-1"]}, "invalid event"), ({"kind": "decision"}, "invalid event"), ({"structured_data": {"rationale": 1}}, "invalid event"),
        ({"created_at": "2024-13-01T00:00:00.000Z"}, "invalid event"), ({"body": "token=abcdefgh1"}, "invalid event"), ({"applies_to": ["."]}, None),
        ({"tags": ["x"] * 257}, "invalid tags"), ({"provenance": {"actor": "a", "method": "explicit", "agent": None}}, None),
    ],
)
def test_rules_of_events(change, rule):
    line = strict_ledger.canonical(GOOD | change)
    assert strict_ledger.broken_rule(line)[1] == rule


def test_forms_of_lines():
    line = strict_ledger.canonical(GOOD)
    assert strict_ledger.broken_rule(line[:-1])[1] == "invalid json"
    assert strict_ledger.broken_rule('{"a":1,"a":2}')[1] == "duplicate keys"
    assert strict_ledger.broken_rule('{"a":{"b":1,"b":1}}')[1] == "duplicate keys"
    assert strict_ledger.broken_rule("[]")[1] == "not an object"
    assert strict_ledger.broken_rule(line.replace(":0.5", ":5e-1")) == ("evt-1", "not canonical")
    assert strict_ledger.broken_rule("[" * 100_000)[1] == "invalid json"


def test_ledger_files_are_numbered_over_blocks(spark, tmp_path):
    lines = [strict_ledger.canonical(GOOD | {"id": f"evt-{i}", "body": "x" * (i % 50 + 1)}) for i in range(400)]
    lines[7], lines[9] = "", "\t "
    lines[11] = lines[10]
    (tmp_path / "events.jsonl").write_bytes("\r\n".join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = strict_ledger.checked(strict_ledger.numbered_lines(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["line_number"]: r["line"] for r in got} == {i + 1: x for i, x in enumerate(lines) if x.strip()}
    assert {r["line_number"]: r["rule"] for r in got if r["rule"]} == {12: "duplicate id"}


def test_digests_of_long_ledgers(spark, monkeypatch):
    monkeypatch.setattr(strict_ledger, "FOLD", 3)
    rows = [("a", i, f"line {i}") for i in range(1, 30)] + [("b", 1, "x")]
    lines = spark.createDataFrame(rows, "ledger string, line_number long, line string")
    whole = strict_ledger.attestation(lines).where("ledger = 'a'").first()
    assert whole["n_lines"] == 29 and whole["size_bytes"] == sum(len(x) + 1 for k, _, x in rows if k == "a")
    assert strict_ledger.attestation(lines.where("line_number <> 17")).where("ledger = 'a'").first()["digest"] != whole["digest"]
    old = strict_ledger.attestation(lines.where("line_number <= 10"))
    assert {r["ledger"]: r["verdict"] for r in strict_ledger.extension(old, lines).collect()} == {"a": "extended", "b": "same"}


def test_lineages(spark):
    schema = "logical_key string, id long, ledger_index long, predecessor_id long, action string, supersedes array<long>, created_at string, candidate string, candidate_fingerprint string"
    chain = lambda key, first, n: [(key, first + i, i, first + i - 1 if i else None, "SUPERSEDE" if i else "ADD", [first + i - 1] if i else [], f"{i:04}", str(i), str(i)) for i in range(n)]
    rows = chain("long", 1000, 300)
    fork = chain("fork", 1, 3)
    fork.append(("fork", 4, 3, 1, "SUPERSEDE", [1], "0009", "z", "z"))
    ring = [("ring", 10, 0, None, "ADD", [], "0000", "a", "a"), ("ring", 11, 1, 13, "SUPERSEDE", [13], "0001", "b", "b"), ("ring", 12, 2, 11, "SUPERSEDE", [11], "0002", "c", "c"),
            ("ring", 13, 3, 12, "SUPERSEDE", [12], "0003", "d", "d"), ("ring", 14, 4, 13, "SUPERSEDE", [13], "0004", "e", "e")]
    empty = ledger.lineage_errors(spark.createDataFrame([], schema))
    assert not empty.count()
    got = {(r["logical_key"], r["id"], r["problem"]) for r in ledger.lineage_errors(spark.createDataFrame(rows + fork + ring, schema)).collect()}
    assert got == {
        ("fork", None, "multiple-heads"), ("ring", None, "multiple-heads"), ("ring", 11, "orphan-predecessor"), ("ring", 11, "supersession-cycle"), ("ring", 12, "supersession-cycle"),
        ("ring", 13, "supersession-cycle"), ("ring", 14, "disconnected-lineage"),
    }


def test_guards_of_lineages(spark):
    events = spark.createDataFrame([(1, "agent", []), (2, "agent", [1]), (3, "tool", [2]), (4, "human", [3, 2]), (5, "tool", [9]), (6, "tool", [1])], "id long, authority string, supersedes array<long>")
    managed = spark.createDataFrame([(1, "a"), (2, "a"), (9, "b")], "id long, logical_key string")
    got = {r["logical_key"]: (r["tool_descendant"], r["higher_descendant"]) for r in ledger.lineage_guards(events, managed).collect()}
    assert got == {"a": (True, True), "b": (True, False)}


@pytest.mark.parametrize(
    ("word", "root"),
    [
        ("consign", "consign"), ("consigned", "consign"), ("consisting", "consist"), ("consistency", "consist"), ("consolations", "consol"), ("knaves", "knave"), ("kneeled", "kneel"),
        ("knitting", "knit"), ("knots", "knot"), ("relational", "relat"), ("generate", "generat"), ("general", "general"), ("arsenal", "arsenal"), ("hopefulness", "hope"), ("adjustable", "adjust"),
        ("employment", "employ"), ("flies", "fli"), ("dies", "die"), ("cosmos", "cosmos"), ("exceeding", "exceed"), ("sayings", "say"), ("beauty", "beauti"), ("by", "by"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"),
    ],
)
def test_stems(word, root):
    assert stem(word) == root


def test_index_after_many_batches(spark, tmp_path):
    root = str(tmp_path / "index")
    add = lambda rows, batch: keyword_index.add(spark.createDataFrame(rows, "memory_id long, t string"), keyword_index.folded(F.col("t")), root, batch)
    add([(1, "red fox, red hen"), (2, "Fox's den"), (3, "")], 1)
    keyword_index.remove(spark.createDataFrame([(1,), (7,)], "memory_id long"), root, 2)
    add([(1, "blue fox s")], 2)
    keyword_index.remove(spark.createDataFrame([(2,), (1,)], "memory_id long"), root, 3)
    add([(2, "RÉD fox's fox")], 3)
    assert keyword_index.totals(spark, root) == (2, 2.0)
    assert {r["memory_id"] for r in keyword_index.rank(spark, root, "fox's").collect()} == {2}
    assert {r["memory_id"] for r in keyword_index.rank(spark, root, "red blue").collect()} == {2}
    assert not keyword_index.rank(spark, root, " , ").count() and not keyword_index.rank(spark, root, "unknown").count()


@pytest.mark.parametrize("language", [None, "english"])
def test_postings_are_made_without_a_shuffle(spark, monkeypatch, language):
    """A record's words are all in its row; the postings equal a plain loop, however few words are taken at once."""
    monkeypatch.setattr(keyword_index, "WORDS_AT_ONCE", 3)
    texts = {1: "red fox\u0000Red hens red", 2: "", 3: None, 4: "\u0000", 5: "the running of the runs, E\u0301t\u00e9 \u0301", 6: "x"}
    want = set()
    for i, text in texts.items():
        words = re.findall(r"[^\W_]+|\x00", keyword_index.folded_text(text or ""))
        n, at = sum(w != "\u0000" for w in words), {}
        for k, w in enumerate(words):
            if w != "\u0000" and not (language and w in STOP_WORDS):
                at.setdefault(stem(w) if language else w, []).append(k)
        want |= {(t, i, n, tuple(p)) for t, p in at.items()} | {(None, i, n, None)}
    df = spark.createDataFrame([*texts.items()], "memory_id long, t string")
    got = keyword_index.places(df, keyword_index.folded(F.col("t")), language)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert {(r["term"], r["memory_id"], r["n"], r["positions"] and tuple(r["positions"])) for r in got.collect()} == want


def test_pairs_meet_on_terms(spark):
    rows = [("g", 1, "it is not blue"), ("g", 2, "It is blue"), ("g", 3, "never"), ("g", 4, "green"), ("h", 5, "is blue")]
    df = spark.createDataFrame(rows, "g string, id long, t string")
    assert [tuple(r) for r in retrieval.contradictions(df, "g", "id", "t").collect()] == [("g", 1, 2, 3)]
    assert re.fullmatch(ignore.glob_pattern("**/[!a]?.ts"), "x/b1.ts")


def test_lines_of_one_ledger_are_numbered_over_several_tasks(spark):
    lines = strict._ledger_lines(spark, f"{DATA}/sf0.001")
    assert lines.select("ledger", F.spark_partition_id().alias("task")).distinct().groupBy("ledger").count().agg(F.max("count")).first()[0] > 1
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 1009).alias("at"))
    got = {(r["g"], r["at"]): (r["k"], r["k_total"]) for r in ledger.numbered(rows, ["g"], ["at"], "k", F.col("at")).collect()}
    want, seen = {}, {}
    for g, at in sorted(((r["g"], r["at"]) for r in rows.collect()), key=lambda x: x[1]):
        n, total = seen.get(g, (0, 0))
        seen[g] = want[g, at] = (n + 1, total + at)
    assert got == want


def test_what_passes_the_bound_of_an_append_is_refused(spark):
    line = lambda i: strict_ledger.canonical(GOOD | {"id": f"evt-{i}"})
    held = spark.createDataFrame([("a", 1, line(1)), ("a", 2, line(2))], "ledger string, line_number long, line string")
    more = spark.createDataFrame([("a", 1, line(2)), ("a", 2, line(3)), ("a", 3, "no"), ("a", 4, line(4)), ("a", 5, line(5))], "ledger string, place long, line string")
    after, refused = strict_ledger.appended(held, more, strict_ledger.attestation(held), most_bytes=4 * (len(line(1)) + 1))
    assert sorted((r["line_number"], r["line"]) for r in after.collect()) == [(i, line(i)) for i in (1, 2, 3, 4)]
    assert sorted((r["line"], r["rule"]) for r in refused.collect()) == sorted([(line(2), "duplicate id"), ("no", "invalid json"), (line(5), "too large")])


def test_guards_of_a_long_lineage_take_few_rounds(spark, monkeypatch):
    rows = [(1, "human", [])] + [(i, "human", [i - 1]) for i in range(2, 301)]  # a chain down to the managed 1
    rows += [(400, "tool", [300, 401]), (401, "agent", [402]), (402, "agent", [401, 403]), (403, "agent", [404]), (404, "agent", [500])]  # branches, a circle
    rows += [(500, "human", [])] + [(600, "tool", [601])] + [(i, "agent", [i + 1 if i < 605 else 601]) for i in range(601, 606)]  # a circle that leads nowhere
    events = spark.createDataFrame(rows, "id long, authority string, supersedes array<long>")
    managed = spark.createDataFrame([(1, "a"), (500, "b"), (700, "c")], "id long, logical_key string")
    written, real = [], ledger.saved
    monkeypatch.setattr(ledger, "saved", lambda df: written.append(1) or real(df))
    assert sorted(map(tuple, ledger.lineage_guards(events, managed).collect())) == [("a", True, False), ("b", True, False)]
    assert len(written) < 30

"""Chunks of code in several languages."""

from memloom.operators import code_chunks

PYTHON = '''import os
from a import b

class Store:
    """Keeps things."""

    def get(self, key):
        if key:
            return 1

        return None

    async def put(self):
        pass


def _helper():
    def inner():
        return "}"
    return inner

X = 1
'''

SCRIPT = """import a from "./a";
// about f
export async function f(x) {
  const g = (y) => {
    return `{${y}}`;
  };
  if (x) {
    return g(x);
  }
}
export type Id = string | number;

class A {
  static make(): A {
    return new A(); // }
  }
  empty() {}
}
const last = async (z) => z;
"""


def test_chunks_by_indent_and_braces(spark):
    files = spark.createDataFrame([("p/store.py", "python", PYTHON), ("s.ts", "typescript", SCRIPT), ("n.txt", None, "class X {"), ("e.py", "python", "")], "path string, language string, content string")
    rows = code_chunks.chunks(files).collect()
    got = {(r["path"], r["kind"], r["name"]): (r["start_line"], r["end_line"], r["parent_symbol"], r["exported"], r["docstring"]) for r in rows}
    assert got == {
        ("p/store.py", "import", None): (1, 2, None, False, None),
        ("p/store.py", "class", "Store"): (4, 14, None, True, "Keeps things."),
        ("p/store.py", "method", "get"): (7, 11, "Store", False, None),
        ("p/store.py", "method", "put"): (13, 14, "Store", False, None),
        ("p/store.py", "function", "_helper"): (17, 20, None, False, None),
        ("p/store.py", "function", "inner"): (18, 19, "_helper", False, None),
        ("p/store.py", "module", "store"): (1, 23, None, False, None),
        ("e.py", "module", "e"): (1, 1, None, False, None),
        ("s.ts", "import", None): (1, 1, None, False, None),
        ("s.ts", "function", "f"): (3, 10, None, True, "about f"),
        ("s.ts", "function", "g"): (4, 6, "f", False, None),
        ("s.ts", "type_alias", "Id"): (11, 11, None, True, None),
        ("s.ts", "class", "A"): (13, 18, None, False, None),
        ("s.ts", "method", "make"): (14, 16, "A", False, None),
        ("s.ts", "method", "empty"): (17, 17, "A", False, None),
        ("s.ts", "function", "last"): (19, 19, None, False, None),
        ("s.ts", "module", "s"): (1, 20, None, False, None),
    }
    content = {r["name"]: r["content"] for r in rows}
    assert content["g"].endswith("};") and content["inner"].startswith("    def inner")


def test_relations_leave_out_known_ones(spark):
    files = spark.createDataFrame([("s.ts", "typescript", SCRIPT), ("s.test.ts", "typescript", "export function f() {}\n")], "path string, language string, content string")
    found = code_chunks.chunks(files)
    links = spark.createDataFrame([("s.ts", "a.ts")], "path string, target string")
    known = spark.createDataFrame([("s.ts::f", "defined_in", "s.ts")], "src string, relation string, dst string")
    got = {tuple(r) for r in code_chunks.relations(found, links, known).select("src", "relation", "dst").collect()}
    assert ("s.ts::f", "defined_in", "s.ts") not in got
    assert {("s.ts::import", "derived_from", "a.ts"), ("s.ts::A.make", "related_to", "s.ts::A"), ("s.test.ts::f", "supports", "s.ts::f"), ("s.ts::f.g", "related_to", "s.ts::f")} <= got


def test_lines_are_spread_over_more_tasks_where_files_are_larger(spark, monkeypatch):
    from memloom.operators import code_chunks

    monkeypatch.setattr(code_chunks, "TASK_BYTES", 500)
    files = spark.createDataFrame([(f"a{i}.py", "python", "def f():\n    return 1\n" * 10) for i in range(40)], "path string, language string, content string")
    found = code_chunks._lines(files)
    assert found.rdd.getNumPartitions() == -(-40 * 220 // 500)
    assert found.count() == 40 * 21 and code_chunks.chunks(files).where("kind = 'function'").count() == 400


def test_written_files_are_spread_by_the_bytes_of_their_text(spark, monkeypatch, tmp_path):
    """Texts that are alike take few bytes of shuffle, so they went by broadcast or into few tasks, whatever they take in memory."""
    from memloom.plans import code

    monkeypatch.setattr(code_chunks, "TASK_BYTES", 20_000)
    spark.createDataFrame([(k, k % 5, f"n{k}") for k in range(40)], "c_custkey long, c_nationkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 40, "F") for k in range(4000)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(5)], "n_nationkey long").write.parquet(f"{tmp_path}/nation.parquet")
    files = code._files(spark, str(tmp_path))
    assert files.where("content LIKE '%class %'").rdd.getNumPartitions() >= 22
    assert files.count() == 40 + 8 + 5
    files.collect()
    assert "BroadcastHashJoin" not in files._jdf.queryExecution().toString()
    assert code_chunks.chunks(files).where("kind = 'method'").count() == 4000

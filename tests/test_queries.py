import re

import pytest
from conftest import DATA, same_rows

from memloom.plans import code, index, knowledge, ledger, overview, repo, retrieval, search, strict, upkeep, writes

QUERIES = retrieval.QUERIES | search.QUERIES | upkeep.QUERIES | ledger.QUERIES | knowledge.QUERIES | strict.QUERIES | index.QUERIES | code.QUERIES | overview.QUERIES | repo.QUERIES | writes.QUERIES
ORACLES = retrieval.ORACLES | search.ORACLES | upkeep.ORACLES | ledger.ORACLES | knowledge.ORACLES | strict.ORACLES | index.ORACLES | code.ORACLES | overview.ORACLES | repo.ORACLES | writes.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_contexts_and_prompts_hold_whole_contents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    best = sorted(docs.values(), key=lambda r: (-(r["doc_id"] % 100), r["doc_id"]))
    for r in knowledge.prompt_assembly(spark, f"{DATA}/sf0.001").collect():
        top = [d for d in best if d["lang"] == r["tenant_id"]][:3]
        assert any(len(d["text"]) > 80 for d in top)
        blocks = [f"\n[#{k}] (fact, score={d['doc_id'] % 100 / 100:.2f}) {d['text'][:60]}\n{d['text']}" for k, d in enumerate(top, 1)]
        assert "<memories>" + "".join(blocks) + "\n</memories>" in r["prompt"]
    packed, got = "", knowledge.agent_context(spark, f"{DATA}/sf0.001").first()
    for d in best[:50]:
        block = ("\n\n" if packed else "") + f"[fact] {d['text'][:60]}\n{d['text']}"
        left = 3000 - len(packed)
        if len(block) > left and left - 2 * bool(packed) < 120:
            break
        packed += block[:left]
        if len(block) > left:
            break
    assert got["context"] == packed


def test_entities_of_all_languages(spark):
    found = {}
    for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect():
        names = list(dict.fromkeys(re.findall(r"[A-Z][a-z]+(?:[ \t\n\f\r]+[A-Z][a-z]+)+", r["text"])))
        if names:
            found[r["doc_id"]] = (len(names), "|".join(names), r["lang"])
    assert {lang for _, _, lang in found.values()} > {"en"}
    got = {r["memory_id"]: (r["n_names"], r["names"]) for r in knowledge.entity_extraction(spark, f"{DATA}/sf0.001").collect()}
    assert got == {k: v[:2] for k, v in found.items()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nearest_vectors_equal_brute_force_and_take_blocks(spark):
    import numpy as np
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from memloom.functions import vector
    from memloom.operators.retrieval import nearest_of_each

    r = np.random.default_rng(5)
    made = [list(map(float, x)) for x in r.integers(-2, 3, (150, 4))] + [[1.0, 2.0, 3.0, 4.0]] * 60 + [[0.0] * 4, [1.0, 2.0], [3.0, 1.0], [1.0, None, 2.0, 0.0], [], None]
    rows = spark.createDataFrame(list(enumerate(made)), "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 5 = 0 OR vec_id > 205")
    pairs = rows.join(queries.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), (F.size("embedding") == F.size("q")) & (F.col("vec_id") != F.col("query")) & F.col("embedding").isNotNull() & F.col("q").isNotNull())
    near = pairs.select("query", "vec_id", F.round(vector.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    want = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id")).cast("long")).where("place <= 7")
    found = nearest_of_each(rows, queries, 7, block=16)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan

"""The pipeline's stages on nulls, repeated rows, clashing columns and empty tables."""

import corpus_pipeline
import pytest
from conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{k % 37} and more{k % 11}" for k in range(120))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(1, PROSE, "en", "a", 5), (1, PROSE, "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (None, None, None, None, None), (4, "x" * 300_000, "de", "b", 1), (5, "short", "en", "b", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = stage(spark, docs, f"{DATA}/sf0.001")
    assert set(docs.columns) <= set(got.columns)
    kept = got.collect()
    assert {r["doc_id"] for r in kept} <= {r[0] for r in rows}
    if name in ("line_dedup", "benchmark_decontamination"):
        assert len(kept) == len(rows)
    if name == "minhash_near_dedup":
        assert {r["doc_id"] for r in kept} == {r[0] for r in rows}
    assert stage(spark, docs.limit(0), f"{DATA}/sf0.001").count() == 0


def test_a_run_on_another_input_is_not_taken_up(spark, tmp_path, monkeypatch):
    seen = []
    stages = [(name, lambda s, docs, d, n=name: seen.append((n, d)) or docs) for name, _ in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    for sf in ("sf0.001", "sf0.001", "sf0.01"):
        corpus_pipeline.run(spark, f"{DATA}/{sf}", str(tmp_path / "run")).count()
    first = [n for n, d in seen if d.endswith("sf0.001")]
    assert first.count("line_dedup") == 1 and [n for n, d in seen if d.endswith("sf0.01")] == [n for n, _ in stages]

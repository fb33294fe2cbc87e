"""From raw documents to a training mix: five stages over the operators of ``memloom.llm``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import decontam, lines, minhash, mixing, quality
from memloom.llm.common import checkpoint, ensure_checkpoint_dir, lookup, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.without_bad(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly equal an earlier one."""
    return lines.dedupe_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    others = checkpoint(
        minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_other")).distinct()
    )
    return docs.join(lookup(others), F.col("doc_id").cast("long") == F.col("_other"), "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come near their target weights, shuffled."""
    return mixing.mix(docs).drop("shuffle_key")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_benchmark),
    ("mix_sources", mix_sources),
]

#: The stages train and apply models, which SQL can't express; tests hold them against plain code.
ORACLE_SQL = None


def _is_whole(spark: SparkSession, path: str, said: tuple[str, str]) -> bool:
    """Whether a stage's rows were written to the end, from this input by these stages: the mark beside them is written last."""
    try:
        return [tuple(r) for r in spark.read.parquet(f"{path}.done").select("input", "stages").collect()] == [said]  # one row
    except AnalysisException:
        return False


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The rows of the last stage; each stage before it is written to the shared folder and read again.

    With a ``folder`` of its own, a run that failed is taken up after its last whole stage when
    it is called again on the same input with the same stages before it. Each stage states in its operator what it does with nulls, empty texts
    and repeated rows; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(spark)
    path = folder or f"{spark.sparkContext.getCheckpointDir()}/corpus_pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        said = (sf_dir, ",".join(name for name, _ in STAGES[: k + 1]))
        if folder is None or not _is_whole(spark, f"{path}/{k}", said):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{path}/{k}")
            spark.createDataFrame([said], "input string, stages string").write.mode("overwrite").parquet(f"{path}/{k}.done")
        docs = spark.read.parquet(f"{path}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)

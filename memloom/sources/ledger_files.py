"""Ledgers kept as files of one JSON object a line, and versioned folders of derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a ledger event, of which all may be missing in older lines.
EVENT = """schema_version int, id string, kind string, subject_type string, title string, body string, structured_data string,
status string, applies_to array<string>, sources array<struct<path:string,symbol:string,start_line:int,end_line:int,blob:string,commit:string>>,
provenance struct<actor:string,method:string,agent:string,session_id:string,command:string>, authority string, confidence double,
importance double, sensitivity string, created_at string, updated_at string, supersedes array<string>, tags array<string>, triggers array<string>"""


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The events of a ledger, and the lines that aren't one JSON object of that form; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", EVENT + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    good = F.col("e._corrupt").isNull() & F.col("e.id").isNotNull()
    return parsed.where(good).select("e.*").drop("_corrupt"), parsed.where(~good).select(F.col("value").alias("line"))


def attestation(spark: SparkSession, path: str) -> DataFrame:
    """``file, size_bytes, sha256`` of each file, from its raw bytes."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def append(events: DataFrame, path: str) -> None:
    """Add events as lines; files appear whole or not at all, and none is changed."""
    events.write.mode("append").json(path)


def commit_generation(tables: dict[str, DataFrame], root: str, generation: int) -> str:
    """Write derived tables as one generation; its manifest comes last and makes it valid."""
    folder = f"{root}/generation={generation}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, ", ".join(df.columns)) for name, df in sorted(tables.items())]
    spark.createDataFrame(rows, "name string, columns string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return folder

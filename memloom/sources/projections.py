"""The driver tables read as records, feedback, ledger events and graph edges.

``AS_OF`` stands for now, so that no query reads the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

AS_OF = "2024-02-01 00:00:00"
AS_OF_ORDERS = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, with_status: bool = False) -> DataFrame:
    """Documents as memory records; one whose normalised text has a larger id is superseded."""
    docs = table(spark, sf_dir, "documents")
    out = docs.select(
        F.col("doc_id").alias("memory_id"),
        F.col("lang").alias("tenant_id"),
        F.col("source").alias("project_id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        F.array("source").alias("entity_keys"),
        ((F.col("doc_id") % 100) / F.lit(100.0)).alias("importance"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.col("doc_id") % 60)).alias("updated_at"),
    )
    if not with_status:
        return out
    named = out.withColumn("fingerprint", text.fingerprint(text.collapsed(F.col("content"))))
    newest = named.groupBy("fingerprint").agg(F.max("memory_id").alias("newest"))
    return named.join(newest, "fingerprint").withColumn(
        "status", F.when(F.col("memory_id") < F.col("newest"), "superseded").otherwise("active")
    ).drop("newest")


#: ``records`` in SQL, as the common table expression ``memories``.
RECORDS_SQL = r"""named AS (
  SELECT doc_id AS memory_id, lang AS tenant_id, source AS project_id, substr(text, 1, 60) AS title, text AS content,
         (doc_id % 100) / 100.0::DOUBLE AS importance, TIMESTAMP '2024-02-01' - to_days((doc_id % 60)::INTEGER) AS updated_at,
         sha256(trim(regexp_replace(lower(text), '[ \t\n\f\r]+', ' ', 'g'))) AS fingerprint
  FROM documents
), memories AS (
  SELECT *, CASE WHEN memory_id < max(memory_id) OVER (PARTITION BY fingerprint) THEN 'superseded' ELSE 'active' END AS status
  FROM named
)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback: good and poor quality, and a correction where toxic."""
    labels = table(spark, sf_dir, "labels")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("quality") == 1, "positive").otherwise("negative"),
            F.when(F.col("toxic") == 1, "correction"),
        )
    )
    return labels.select(F.col("doc_id").alias("memory_id"), F.explode(kinds).alias("feedback_type"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger: each supersedes the one before it of the same user and type.

    Errors are retracted; the authority comes from the type. ``created_at`` keeps the order.
    """
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", "event_type", "value"
    )
    chain = Window.partitionBy("user_id", "event_type").orderBy("created_at", "id")
    authority = (
        F.when(F.col("event_type") == "purchase", "human").when(F.col("event_type") == "signup", "system")
        .when(F.col("event_type") == "error", "tool").otherwise("agent")
    )
    return events.select(
        "id",
        "created_at",
        F.concat_ws(":", "user_id", "event_type").alias("subject"),
        "user_id",
        F.col("event_type").alias("kind"),
        F.when(F.col("event_type") == "error", "retracted").otherwise("active").alias("status"),
        authority.alias("authority"),
        F.array_compact(F.array(F.lag("id").over(chain))).alias("supersedes"),
        "value",
    )


#: ``ledger`` in SQL, as the common table expression ``ledger``; ``prior`` is what an event supersedes.
LEDGER_SQL = """ledger AS (
  SELECT event_id AS id, ts AS created_at, user_id || ':' || event_type AS subject, user_id, event_type AS kind,
         CASE WHEN event_type = 'error' THEN 'retracted' ELSE 'active' END AS status,
         CASE event_type WHEN 'purchase' THEN 'human' WHEN 'signup' THEN 'system' WHEN 'error' THEN 'tool' ELSE 'agent' END AS authority,
         lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prior, value
  FROM events
)"""


def place_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, type, weight``: regions contain nations, nations contain customers and suppliers."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))
    return (
        edge(nation, node("region", "n_regionkey"), node("nation", "n_nationkey"))
        .unionByName(edge(customer, node("nation", "c_nationkey"), node("customer", "c_custkey")))
        .unionByName(edge(supplier, node("nation", "s_nationkey"), node("supplier", "s_suppkey")))
    )


#: ``place_graph`` in SQL, as the common table expression ``edges``.
GRAPH_SQL = """edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
)"""

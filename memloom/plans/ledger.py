"""Queries: ledger, lifecycle and observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger as G
from ..operators import lifecycle as C
from ..operators import observe as O

from ..sources.projections import AS_OF_ORDERS, LEDGER_SQL, RECORDS_SQL, ledger, records, table

MIDDLE = "2024-01-16 00:00:00"


def ledger_active_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.active_heads(ledger(spark, sf_dir)).select("id", "subject", "status")


def ledger_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.heads_as_of(ledger(spark, sf_dir), MIDDLE).select("id", "subject")


def temporal_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.intervals(ledger(spark, sf_dir))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("id", shown("valid_from"), shown("valid_to"), "n_predecessors", "n_successors")


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger in which each event supersedes the user's previous one of any type, and some nothing known."""
    events = ledger(spark, sf_dir)
    before = F.lag("id").over(Window.partitionBy("user_id").orderBy("created_at", "id"))
    odd = F.when(F.col("id") % 50 == 0, -F.col("id") - 1).when(F.col("id") % 70 == 0, F.col("id"))
    return events.withColumn("supersedes", F.array_compact(F.array(F.coalesce(odd, before))))


def admission_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.admission(_crossed(spark, sf_dir)).where("violation IS NOT NULL").select("id", "target", "violation")


def interval_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.interval_violations(_crossed(spark, sf_dir)).groupBy("problem").agg(F.count("*").alias("n"))


def timeline_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lineage(ledger(spark, sf_dir))


def reconcile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' profiles: the last event of each type before the middle of the month against after it."""
    events = ledger(spark, sf_dir).withColumnRenamed("subject", "logical_key")
    middle = F.lit(MIDDLE).cast("timestamp_ntz")
    mark = F.floor(F.col("value") / 50).cast("string")
    side = lambda df: O.latest(df.select("logical_key", "created_at", "id", mark.alias("fingerprint"), "authority"), ["logical_key"], ["created_at", "id"])
    return G.reconcile(side(events.where(F.col("created_at") < middle)), side(events.where(F.col("created_at") >= middle)))


def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: an old index without every seventh, with every fifth in another version."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id")).alias("path"), "doc_id", F.sha2("text", 256).alias("sha256"))
    old = docs.where("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256")))
    new = docs.where("doc_id % 11 <> 0")
    return G.index_diff(old, new)


def tombstone_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ledger(spark, sf_dir)
    erased = events.where("user_id % 10 = 3").select("id")
    return G.suppressed(events, erased).groupBy("kind", "suppressed").agg(F.count("*").alias("n"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer as rows to merge: the later half of the years into the earlier."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    cut = F.lit("1998-01-01").cast("timestamp")
    merged = G.upsert(
        O.latest(rows.where(F.col("o_orderdate") < cut), ["o_custkey"], ["o_orderdate", "o_orderkey"]),
        O.latest(rows.where(F.col("o_orderdate") >= cut), ["o_custkey"], ["o_orderdate", "o_orderkey"]),
        ["o_custkey"], "o_orderdate",
    )
    return merged.select("o_custkey", "o_orderkey", "o_totalprice")


HOLDS = (
    C.Hold("litigation", ids=tuple(range(1, 40)), until="2002-01-01"),
    C.Hold("audit", scope={"c_mktsegment": "BUILDING", "o_orderstatus": "O"}),
    C.Hold("closed", scope={"c_mktsegment": "MACHINERY"}, until="2000-01-01"),
    C.Hold("tax", scope={"o_orderpriority": "1-URGENT"}, until="2001-12-01"),
)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return table(spark, sf_dir, "orders").join(segments, F.col("o_custkey") == F.col("c_custkey"))


def legal_hold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.hold_states(_orders(spark, sf_dir), HOLDS, "2001-08-02", "o_orderkey")


POLICIES = (C.Policy("urgent", 365, "1-URGENT"), C.Policy("low", 730, "5-LOW"), C.Policy("any", 2000))


def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = C.due_for_retention(table(spark, sf_dir, "orders"), POLICIES, AS_OF_ORDERS, "o_orderdate", "o_orderpriority")
    return due.select("o_orderkey", "policy_id")


def erase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    nation = orders.where("c_nationkey = 5").withColumnRenamed("o_orderkey", "memory_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"))
    held = C.hold_states(orders, HOLDS, "2001-08-02", "o_orderkey").withColumnRenamed("o_orderkey", "memory_id")
    return C.erasure(nation, {"lines": lines}, held)


def rtbf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer how many orders can be erased and how many are held."""
    orders = _orders(spark, sf_dir)
    held = C.hold_states(orders, HOLDS, "2001-08-02", "o_orderkey").select("o_orderkey", F.lit(1).alias("held"))
    split = orders.select("o_orderkey", "o_custkey").join(held, "o_orderkey", "left")
    return split.groupBy("o_custkey").agg(F.count_if(F.col("held").isNull()).alias("n_erased"), F.count("held").alias("n_held"))


def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = records(spark, sf_dir).select("memory_id", T.fingerprint(T.collapsed(F.col("content"))).alias("fingerprint"))
    groups = named.groupBy("fingerprint").agg(F.min("memory_id").alias("kept"), F.count("*").alias("n"))
    return groups.where("n > 1").select("kept", "n", "fingerprint")


def soft_delete_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of old years softly deleted: held ones keep their state and wait."""
    orders = _orders(spark, sf_dir).withColumn("status", F.lit("active"))
    held = C.hold_states(orders, HOLDS, "2001-08-02", "o_orderkey")
    ids = orders.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    after = C.deleted(orders.select("o_orderkey", "status"), ids, held, key="o_orderkey")
    return after.groupBy("status", F.coalesce("pre_hold_status", F.lit("")).alias("waiting")).agg(F.count("*").alias("n"))


def storage_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = records(spark, sf_dir, with_status=True)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("memory_id")).distinct().withColumn("labelled", F.lit(True))
    return O.conditional_counts(
        df.join(labelled, "memory_id", "left"), ["tenant_id"],
        {"active": F.col("status") == "active", "superseded": F.col("status") == "superseded", "important": F.col("importance") >= 0.8,
         "recent": F.col("updated_at") >= F.lit("2024-01-25").cast("timestamp_ntz"), "with_feedback": F.coalesce("labelled", F.lit(False)),
         "long": F.length("content") > 4000},
    )


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a supplier as a connector's sources, last synced when last shipped."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("connector_id"), F.col("l_partkey").alias("source_id")).agg(
        F.max(F.col("l_shipdate").cast("timestamp_ntz")).alias("last_synced"), F.count("*").alias("n_grants")
    )


def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    connectors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("connector_id"), (F.col("s_nationkey") * 86400 * 30).alias("sla"))
    joined = _sources(spark, sf_dir).join(connectors, "connector_id", "left")
    deadline = O.freshness_deadline(F.lit(None).cast("timestamp_ntz"), F.col("last_synced"), F.col("sla"))
    return joined.select(
        "connector_id", "source_id", F.date_format(deadline, "yyyy-MM-dd").alias("deadline"),
        F.coalesce(deadline < F.lit(AS_OF_ORDERS).cast("timestamp_ntz"), F.lit(False)).alias("breached"),
    )


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = source_freshness(spark, sf_dir).groupBy("connector_id").agg(F.count("*").alias("n_sources"), F.count_if("breached").alias("n_breached"))
    connectors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("connector_id"), "s_acctbal")
    missing = F.array_compact(F.array(F.when(F.col("n_sources").isNull(), "sources"), F.when(F.col("s_acctbal") < 0, "credentials")))
    return connectors.join(fresh, "connector_id", "left").select(
        "connector_id", F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"),
        F.coalesce("n_breached", F.lit(0)).cast("long").alias("n_breached"), F.array_join(missing, ", ").alias("missing"),
    )


def integrity_audit_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part, supplier, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "orders", "customer"))
    return (
        O.orphans(lines, ["l_partkey"], part.where("p_size > 2"), ["p_partkey"], "line without part")
        .unionByName(O.orphans(lines, ["l_suppkey"], supplier.where("s_acctbal > 0"), ["s_suppkey"], "line without supplier"))
        .unionByName(O.orphans(lines, ["l_orderkey"], orders, ["o_orderkey"], "line without order"))
        .unionByName(O.orphans(orders, ["o_custkey"], customer.where("c_custkey % 9 <> 0"), ["c_custkey"], "order without customer"))
    )


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    return O.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def history_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    ranked = table(spark, sf_dir, "events").withColumn("place", F.row_number().over(newest).cast("long"))
    return ranked.where("place <= 5").select("user_id", "place", "event_id", "event_type")


def project_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each project its records by tenant, and the three latest titles of the important ones."""
    df = records(spark, sf_dir)
    counts = df.groupBy("project_id").agg(F.count("*").alias("n"), F.count_distinct("tenant_id").alias("n_tenants"))
    order = Window.partitionBy("project_id").orderBy(F.desc("updated_at"), F.asc("memory_id"))
    latest = df.where("importance >= 0.5").withColumn("k", F.row_number().over(order)).where("k <= 3")
    shown = latest.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "memory_id"))), lambda x: x["memory_id"].cast("string")), ",").alias("recent"))
    return counts.join(shown, "project_id", "left").select("project_id", "n", "n_tenants", F.coalesce("recent", F.lit("")).alias("recent"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [5, 25, 100, 250])
    return found.withColumn("total", F.round("total", 4))


def dir_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    return O.directory_counts(table(spark, sf_dir, "pages").select(path.alias("path")))


def scheduler_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as connectors, their latest order as the latest job."""
    jobs = O.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    joined = table(spark, sf_dir, "customer").join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left")
    reason = O.skip_reason(
        F.when(F.col("c_acctbal") < 0, "paused").otherwise("active"), F.col("c_nationkey") != 0, F.when(F.col("c_custkey") % 13 != 0, F.col("c_nationkey") * 86400 * 20),
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("done"), F.col("o_orderdate").cast("timestamp_ntz"),
        F.lit(AS_OF_ORDERS).cast("timestamp_ntz"), F.col("c_mktsegment") != "FURNITURE",
    )
    return joined.select("c_custkey", F.coalesce(reason, F.lit("run")).alias("decision"))


def onboarding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each nation has come: suppliers as connectors, customers as records, lines as grants."""
    by = lambda t, k, n: table(spark, sf_dir, t).groupBy(F.col(k).alias("nation")).agg(F.count("*").alias(n))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    grants = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum("n").alias("grants"))
    joined = by("supplier", "s_nationkey", "connectors").join(by("customer", "c_nationkey", "records"), "nation", "full_outer").join(grants, "nation", "left")
    joined = joined.fillna(0)
    return joined.withColumn("stage", O.production_evidence(F.col("connectors"), F.col("records"), F.col("grants")))


QUERIES = {
    f.__name__: f
    for f in (
        ledger_active_heads, ledger_as_of, temporal_intervals, admission_violations, interval_violations, timeline_lineage, reconcile_actions,
        index_diff, tombstone_suppression, upsert_latest, legal_hold_state, retention_candidates, erase_counts, rtbf_split, content_dedupe,
        soft_delete_held, storage_overview, source_freshness, coverage_summary, integrity_audit_anti, latest_snapshot, history_newest_n,
        project_overview, latency_percentiles, metric_histogram, dir_file_counts, scheduler_skip_reason, onboarding_evidence,
    )
}

_CROSSED = f"""WITH {LEDGER_SQL}, before AS (
  SELECT *, lag(id) OVER (PARTITION BY user_id ORDER BY created_at, id) AS last FROM ledger
), crossed AS (
  SELECT *, CASE WHEN id % 50 = 0 THEN -id - 1 WHEN id % 70 = 0 THEN id ELSE last END AS target,
         CASE authority WHEN 'tool' THEN 1 WHEN 'agent' THEN 2 WHEN 'system' THEN 3 ELSE 4 END AS rank FROM before
), linked AS (
  SELECT c.id, c.target, c.rank, c.created_at, t.rank AS target_rank, t.created_at AS target_at FROM crossed c LEFT JOIN crossed t ON t.id = c.target WHERE c.target IS NOT NULL
)"""
_ORDERS = "o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"
_HELD = f"""{_ORDERS}, held AS (
  SELECT o_orderkey, list_filter([CASE WHEN c_mktsegment = 'BUILDING' AND o_orderstatus = 'O' THEN 'audit' END,
    CASE WHEN o_orderkey BETWEEN 1 AND 39 THEN 'litigation' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'tax' END], lambda x: x IS NOT NULL) AS r,
    CASE WHEN NOT (c_mktsegment = 'BUILDING' AND o_orderstatus = 'O') THEN
      CASE WHEN o_orderkey BETWEEN 1 AND 39 THEN '2002-01-01' WHEN o_orderpriority = '1-URGENT' THEN '2001-12-01' END END AS hold_until
  FROM o
)"""
_FRESH = """sources AS (
  SELECT l_suppkey AS connector_id, l_partkey AS source_id, max(l_shipdate) AS last_synced FROM lineitem GROUP BY 1, 2
), fresh AS (
  SELECT connector_id, source_id, CASE WHEN s_nationkey > 0 THEN last_synced + to_days(s_nationkey * 30) END AS d
  FROM sources LEFT JOIN supplier ON s_suppkey = connector_id
), judged AS (SELECT connector_id, source_id, strftime(d, '%Y-%m-%d') AS deadline, coalesce(d < TIMESTAMP '2001-08-02', false) AS breached FROM fresh)"""

ORACLES = {
    "ledger_active_heads": f"WITH {LEDGER_SQL} SELECT id, subject, status FROM ledger WHERE status = 'active' AND id NOT IN (SELECT prior FROM ledger WHERE prior IS NOT NULL)",
    "ledger_as_of": f"WITH {LEDGER_SQL}, known AS (SELECT * FROM ledger WHERE created_at <= TIMESTAMP '{MIDDLE}') SELECT id, subject FROM known WHERE status = 'active' AND id NOT IN (SELECT prior FROM known WHERE prior IS NOT NULL)",
    "temporal_intervals": f"""WITH {LEDGER_SQL}, after AS (SELECT prior, min(created_at) AS ends, count(*) AS n FROM ledger WHERE prior IS NOT NULL GROUP BY 1)
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(coalesce(ends, CASE WHEN status <> 'active' THEN created_at END), '%Y-%m-%d %H:%M:%S') AS valid_to,
       (l.prior IS NOT NULL)::BIGINT AS n_predecessors, coalesce(n, 0) AS n_successors FROM ledger l LEFT JOIN after a ON a.prior = l.id""",
    "admission_violations": f"""{_CROSSED} SELECT id, target, CASE WHEN id = target THEN 'self reference' WHEN target_at IS NULL THEN 'unknown reference'
  WHEN rank < target_rank THEN 'lower authority' ELSE 'earlier than target' END AS violation FROM linked
WHERE id = target OR target_at IS NULL OR rank < target_rank OR created_at < target_at""",
    "interval_violations": f"""{_CROSSED}, found AS (
  SELECT 'duplicate id' AS problem FROM crossed GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown reference' FROM linked WHERE target_at IS NULL
  UNION ALL SELECT 'begins before what it supersedes' FROM linked WHERE created_at < target_at
) SELECT problem, count(*) AS n FROM found GROUP BY 1""",
    "timeline_lineage": f"""WITH RECURSIVE {LEDGER_SQL}, chain(id, root, depth) AS (
  SELECT id, id, 0::BIGINT FROM ledger WHERE prior IS NULL UNION ALL SELECT l.id, c.root, c.depth + 1 FROM chain c JOIN ledger l ON l.prior = c.id
) SELECT id, root, depth FROM chain""",
    "reconcile_actions": f"""WITH {LEDGER_SQL}, old AS (
  SELECT subject, arg_max(floor(value / 50)::BIGINT::VARCHAR, (created_at, id)) AS f, arg_max(authority, (created_at, id)) AS a FROM ledger WHERE created_at < TIMESTAMP '{MIDDLE}' GROUP BY 1
), new AS (SELECT subject, arg_max(floor(value / 50)::BIGINT::VARCHAR, (created_at, id)) AS f FROM ledger WHERE created_at >= TIMESTAMP '{MIDDLE}' GROUP BY 1)
SELECT coalesce(old.subject, new.subject) AS logical_key, CASE WHEN old.f IS NULL THEN 'ADD' WHEN new.f IS NULL THEN 'RETRACT' WHEN old.f = new.f THEN 'NOOP'
  WHEN a = 'human' THEN 'CONFLICT' ELSE 'SUPERSEDE' END AS action FROM old FULL JOIN new ON old.subject = new.subject""",
    "index_diff": """WITH d AS (SELECT source || '/' || doc_id AS path, doc_id, sha256(text) AS h FROM documents),
old AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN sha256(h || 'x') ELSE h END AS h FROM d WHERE doc_id % 7 <> 0), new AS (SELECT path, h FROM d WHERE doc_id % 11 <> 0)
SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END AS change
FROM old FULL JOIN new ON old.path = new.path""",
    "tombstone_suppression": f"WITH {LEDGER_SQL} SELECT kind, user_id % 10 = 3 AS suppressed, count(*) AS n FROM ledger GROUP BY 1, 2",
    "upsert_latest": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1",
    "legal_hold_state": f"WITH {_HELD} SELECT o_orderkey, array_to_string(r, '; ') AS reasons, hold_until FROM held WHERE len(r) > 0",
    "retention_candidates": """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '2001-08-02' - to_days(365) THEN 'urgent'
  WHEN o_orderpriority = '5-LOW' AND o_orderdate < TIMESTAMP '2001-08-02' - to_days(730) THEN 'low' ELSE 'any' END AS policy_id FROM orders
WHERE (o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '2001-08-02' - to_days(365)) OR (o_orderpriority = '5-LOW' AND o_orderdate < TIMESTAMP '2001-08-02' - to_days(730))
   OR o_orderdate < TIMESTAMP '2001-08-02' - to_days(2000)""",
    "erase_counts": f"""WITH {_HELD}, n AS (SELECT o.o_orderkey, len(r) > 0 AS h FROM o JOIN held USING (o_orderkey) WHERE c_nationkey = 5)
SELECT 'n_erased' AS what, count(*) AS n FROM n WHERE NOT h UNION ALL SELECT 'n_held', count(*) FROM n WHERE h
UNION ALL SELECT 'n_lines', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM n WHERE NOT h)""",
    "rtbf_split": f"WITH {_HELD} SELECT o_custkey, count(*) FILTER (len(r) = 0) AS n_erased, count(*) FILTER (len(r) > 0) AS n_held FROM o JOIN held USING (o_orderkey) GROUP BY 1",
    "content_dedupe": f"WITH {RECORDS_SQL} SELECT min(memory_id) AS kept, count(*) AS n, fingerprint FROM memories GROUP BY fingerprint HAVING count(*) > 1",
    "soft_delete_held": f"""WITH {_HELD}, m AS (SELECT o_orderdate < TIMESTAMP '1996-01-01' AS old, len(r) > 0 AS h FROM o JOIN held USING (o_orderkey))
SELECT CASE WHEN old AND NOT h THEN 'deleted' ELSE 'active' END AS status, CASE WHEN old AND h THEN 'deleted' ELSE '' END AS waiting, count(*) AS n FROM m GROUP BY 1, 2""",
    "storage_overview": f"""WITH {RECORDS_SQL}, l AS (SELECT DISTINCT doc_id FROM labels)
SELECT tenant_id, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'superseded') AS superseded, count(*) FILTER (importance >= 0.8::DOUBLE) AS important,
       count(*) FILTER (updated_at >= TIMESTAMP '2024-01-25') AS recent, count(doc_id) AS with_feedback, count(*) FILTER (length(content) > 4000) AS long
FROM memories LEFT JOIN l ON doc_id = memory_id GROUP BY 1""",
    "source_freshness": f"WITH {_FRESH} SELECT * FROM judged",
    "coverage_summary": f"""WITH {_FRESH}, c AS (SELECT connector_id, count(*) AS n, count(*) FILTER (breached) AS b FROM judged GROUP BY 1)
SELECT s_suppkey AS connector_id, coalesce(n, 0) AS n_sources, coalesce(b, 0) AS n_breached,
       array_to_string(list_filter([CASE WHEN n IS NULL THEN 'sources' END, CASE WHEN s_acctbal < 0 THEN 'credentials' END], lambda x: x IS NOT NULL), ', ') AS missing
FROM supplier LEFT JOIN c ON connector_id = s_suppkey""",
    "integrity_audit_anti": """SELECT 'line without part' AS name, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)
UNION ALL SELECT 'line without supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)""",
    "latest_snapshot": """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""",
    "history_newest_n": """SELECT user_id, place, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5""",
    "project_overview": f"""WITH {RECORDS_SQL}, r AS (
  SELECT project_id, memory_id, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, memory_id) AS k FROM memories WHERE importance >= 0.5::DOUBLE
), s AS (SELECT project_id, string_agg(memory_id::VARCHAR, ',' ORDER BY k) AS recent FROM r WHERE k <= 3 GROUP BY 1)
SELECT project_id, count(*) AS n, count(DISTINCT tenant_id) AS n_tenants, coalesce(any_value(recent), '') AS recent FROM memories LEFT JOIN s USING (project_id) GROUP BY 1""",
    "latency_percentiles": "SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM events GROUP BY 1",
    "metric_histogram": """SELECT event_type, count(*) FILTER (value <= 5) AS le_5, count(*) FILTER (value <= 25) AS le_25, count(*) FILTER (value <= 100) AS le_100,
  count(*) FILTER (value <= 250) AS le_250, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""",
    "dir_file_counts": r"""WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT directory, count(*) AS file_count FROM (SELECT unnest(list_transform(range(0, len(parts)), lambda k: CASE WHEN k = 0 THEN '.' ELSE array_to_string(parts[1:k], '/') END)) AS directory FROM p) GROUP BY 1""",
    "scheduler_skip_reason": """WITH j AS (SELECT o_custkey, arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS d, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'inactive' WHEN c_nationkey = 0 THEN 'disabled' WHEN c_custkey % 13 = 0 THEN 'missing cadence' WHEN s = 'P' THEN 'in-progress'
  WHEN d + to_days(c_nationkey * 20) > TIMESTAMP '2001-08-02' THEN 'not-due' WHEN c_mktsegment = 'FURNITURE' THEN 'provider_not_implemented' ELSE 'run' END AS decision
FROM customer LEFT JOIN j ON o_custkey = c_custkey""",
    "onboarding_evidence": """WITH c AS (SELECT s_nationkey AS nation, count(*) AS connectors FROM supplier GROUP BY 1), r AS (SELECT c_nationkey AS nation, count(*) AS records FROM customer GROUP BY 1),
g AS (SELECT s_nationkey AS nation, count(*) AS grants FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
j AS (SELECT coalesce(c.nation, r.nation) AS nation, coalesce(connectors, 0) AS connectors, coalesce(records, 0) AS records FROM c FULL JOIN r ON c.nation = r.nation)
SELECT j.nation, connectors, records, coalesce(grants, 0) AS grants, CASE WHEN connectors >= 3 AND records >= 1000 AND coalesce(grants, 0) >= 100 THEN 'enterprise_candidate'
  WHEN connectors >= 1 AND records >= 50 THEN 'pilot' ELSE 'demo' END AS stage FROM j LEFT JOIN g ON g.nation = j.nation""",
}

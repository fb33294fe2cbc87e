"""Queries: strict ledgers, their attestation, and lineages of managed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ledger as G
from ..sources import strict_ledger as S
from ..sources.projections import LEDGER_SQL, ledger, table


def _ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as canonical lines, a ledger for each type; some are broken by their number."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("value").alias("v"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))
    events = G.numbered(events, ["event_type"], ["event_id"], "line_number")
    at = F.col("event_id")
    odd = lambda k, a, b: F.when(at % 60 == k, a).otherwise(b)
    one_id = F.format_string("event-%05d", odd(1, (at % 120), at))
    line = F.concat(
        F.lit('{"applies_to":["."],"authority":"'), odd(2, F.lit("robot"), F.lit("agent")),
        F.lit('","body":"'), odd(3, F.lit(" blank before"), F.concat(F.lit("of user "), F.col("user_id"))),
        F.lit('","confidence":'), odd(4, F.lit("1.5"), odd(5, F.lit("0.50"), F.lit("0.5"))),
        F.lit(',"created_at":"'), F.col("at"), F.lit('","id":"'), odd(6, F.lit("no"), one_id),
        F.lit('","importance":1,"kind":"'), odd(7, F.lit("decision"), F.lit("fact")), F.lit('","provenance":{"actor":"x","method":"observed"'), odd(8, F.lit(',"place":"here"'), F.lit("")),
        F.lit('},"schema_version":'), odd(9, F.lit("true"), F.lit("1")), F.lit(',"sensitivity":"'), odd(10, F.lit("restricted"), F.lit("internal")),
        F.lit('","sources":['), odd(11, F.lit('{"end_line":1,"path":"a.py","start_line":2}'), odd(12, F.lit('{"path":"../a.py"}'), F.lit('{"path":"a.py","start_line":2}'))), F.lit(']'),
        F.lit(',"status":"active","structured_data":{"n":'), odd(13, F.lit("9007199254740993"), F.format_string("%d", F.floor("v"))), odd(14, F.lit(',"n":1'), F.lit("")), F.lit('},"subject_type":"repo","supersedes":['), odd(15, F.concat(F.lit('"'), one_id, F.lit('"')), F.lit("")),
        F.lit('],"tags":'), odd(16, F.lit('["b","a"]'), odd(17, F.lit('"a"'), F.lit('["a","b"]'))), F.lit(',"title":"'), odd(18, F.lit("password=abcdefghij"), F.lit("Event")), F.lit('","triggers":[],"updated_at":"'), odd(19, F.lit("2001-01-01T00:00:00.000Z"), F.col("at")), F.lit('"}'),
    )
    line = odd(20, F.concat(line, F.lit("}")), odd(21, F.lit("[1]"), odd(22, F.lit("   "), odd(23, F.regexp_replace(line, ":\\[\\]", ": []"), line))))
    return events.select(F.col("event_type").alias("ledger"), "line_number", "event_id", line.alias("line"))


#: ``_ledger_lines`` with the rule that each line breaks, told from its number.
_LINES_SQL = """numbered AS (
  SELECT event_id, event_type AS ledger, event_id % 60 AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_number FROM events
), told AS (
  SELECT ledger, line_number, event_id, k, CASE k
    WHEN 2 THEN 'invalid authority' WHEN 3 THEN 'invalid event' WHEN 4 THEN 'invalid confidence' WHEN 5 THEN 'not canonical' WHEN 6 THEN 'invalid id' WHEN 7 THEN 'invalid event'
    WHEN 8 THEN 'invalid provenance.place' WHEN 9 THEN 'invalid schema_version' WHEN 10 THEN 'invalid event' WHEN 11 THEN 'invalid sources.0' WHEN 12 THEN 'invalid sources.0'
    WHEN 13 THEN 'invalid event' WHEN 14 THEN 'duplicate keys' WHEN 15 THEN 'invalid event' WHEN 16 THEN 'invalid event' WHEN 17 THEN 'invalid tags' WHEN 18 THEN 'invalid event'
    WHEN 19 THEN 'invalid event' WHEN 20 THEN 'invalid json' WHEN 21 THEN 'not an object' WHEN 23 THEN 'not canonical'
  END AS rule, CASE WHEN k = 1 THEN event_id % 120 ELSE event_id END AS own
  FROM numbered WHERE k <> 22
), told_once AS (
  SELECT *, CASE WHEN (rule IS NULL OR rule = 'not canonical') AND line_number > min(line_number) FILTER (rule IS NULL OR rule = 'not canonical') OVER (PARTITION BY ledger, own)
    THEN 'duplicate id' ELSE rule END AS first_rule FROM told
)"""


def strict_ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.checked(_ledger_lines(spark, sf_dir)).where("rule IS NOT NULL").select("ledger", "line_number", "rule")


def strict_ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per ledger its lines, how many of them become events, and how many rules are broken."""
    return S.checked(_ledger_lines(spark, sf_dir)).groupBy("ledger").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("rule").isNull()).alias("n_events"), F.countDistinct("rule").alias("n_rules")
    )


def _order_lines(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """A ledger for each customer, a line an order."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = table(spark, sf_dir, "orders").withColumn("line_number", number)
    return orders.select(F.col("o_custkey").alias("ledger"), F.col("line_number").cast("long"), line.alias("line"))


def _line() -> Column:
    return F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority")



def ledger_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.attestation(_order_lines(spark, sf_dir, _line()))


def ledger_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers of customers attested some lines ago, then cut, changed, lengthened, or lost."""
    lines = _order_lines(spark, sf_dir, _line())
    last = lines.groupBy("ledger").agg(F.max("line_number").alias("last"))
    old = S.attestation(lines.join(last, "ledger").where((F.col("line_number") <= F.col("last") - F.col("ledger") % 3) | (F.col("line_number") == 1)).drop("last"))
    new = lines.where("ledger % 7 <> 1 OR line_number <= 2").where("ledger % 11 <> 2")
    new = new.withColumn("line", F.when((F.col("ledger") % 5 == 3) & (F.col("line_number") == 2), F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return S.extension(old, new, most_bytes=700)


def ledger_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _order_lines(spark, sf_dir, _line())
    said = lines.where("ledger % 9 <> 4 OR line_number <> 3").select("ledger", (F.col("line_number") + (F.col("ledger") % 13 == 5).cast("long")).alias("line_number"), F.col("line").alias("event"))
    return S.disagreements(said, lines)


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line of the strict ledgers appended to the ledger of those before that are good."""
    lines = G.saved(S.checked(_ledger_lines(spark, sf_dir)).select("ledger", "line_number", "line", "rule"))
    mark = F.col("line_number") % 3 == 0
    good = lines.where(~mark & F.col("rule").isNull()).select("ledger", F.col("line_number").alias("place"), "line")
    held = G.saved(G.numbered(good, ["ledger"], ["place"], "line_number").select("ledger", "line_number", "line"))
    more = lines.where(mark).select("ledger", F.col("line_number").alias("place"), "line")
    attested = S.attestation(held).withColumn("digest", F.when(F.col("ledger") == "signup", F.lit("another")).otherwise(F.col("digest")))
    after, refused = S.appended(held, more, attested)
    return after.groupBy("ledger").agg(F.count("*").alias("n_lines"), F.max("line_number").alias("last")).join(refused.groupBy("ledger").agg(F.count("*").alias("n_refused")), "ledger", "left")


def _managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's chains as managed lineages, with pointers, actions and references bent by number."""
    events = ledger(spark, sf_dir).select("id", "created_at", F.col("subject").alias("logical_key"), "value", F.try_element_at("supersedes", F.lit(1)).alias("prior"))
    chain = Window.partitionBy("logical_key").orderBy("created_at", "id")
    mark = F.floor(F.col("value") / 100).cast("string")
    at = F.col("id")
    events = events.withColumn("following", F.lead("id").over(chain))
    events = events.withColumn("predecessor_id", F.when(at % 101 == 0, F.coalesce("following", "prior")).when(at % 211 == 0, None).when(at % 89 == 0, F.lit(-1).cast("long")).otherwise(F.col("prior")))
    action = F.when(at % 97 == 0, "ADD").when(F.col("predecessor_id").isNull(), "ADD").when(at % 5 == 0, "RETRACT").otherwise("SUPERSEDE")
    return events.select(
        "logical_key", "id", F.row_number().over(chain).cast("long").alias("ledger_index"), "predecessor_id", action.alias("action"),
        F.when(at % 83 == 0, F.array().cast("array<bigint>")).otherwise(F.array_compact(F.array("predecessor_id"))).alias("supersedes"),
        "created_at", mark.alias("candidate"), F.sha2(mark, 256).alias("candidate_fingerprint"),
    )


def lineage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems, with an empty id where the whole lineage is at fault."""
    return G.lineage_errors(_managed(spark, sf_dir)).withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))


def lineage_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first events of each chain managed, those after them not."""
    events = ledger(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("subject").orderBy("created_at", "id"))
    numbered = events.withColumn("place", place)
    managed = numbered.where("place <= 1 + user_id % 6").select("id", F.col("subject").alias("logical_key"))
    return G.lineage_guards(numbered.withColumn("authority", F.when(F.col("user_id") % 2 == 0, "tool").otherwise("human")), managed)


QUERIES = {
    f.__name__: f
    for f in (strict_ledger_lines, strict_ledger_summary, ledger_attestation, ledger_extension, ledger_disagreements, ledger_append, lineage_errors, lineage_guards)
}

_ORDERS = "lines AS (SELECT o_custkey AS ledger, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority) AS line FROM orders)"


def _digest(source: str, name: str) -> str:
    """The digest of a ledger of up to 1,024 lines, and of the one more level above it."""
    return f"""{name} AS (
  SELECT ledger, sum(n)::BIGINT AS n_lines, sum(b)::BIGINT AS size_bytes, CASE WHEN (SELECT max(place) FROM {source}) > {S.FOLD} THEN sha256(string_agg(h, '' ORDER BY block)) ELSE any_value(h) END AS digest
  FROM (SELECT ledger, (place - 1) // {S.FOLD} AS block, count(*) AS n, sum(strlen(line) + 1) AS b, sha256(string_agg(sha256(line), '' ORDER BY place)) AS h FROM {source} GROUP BY 1, 2) GROUP BY ledger
)"""


ORACLES = {
    "strict_ledger_lines": f"WITH {_LINES_SQL} SELECT ledger, line_number, first_rule AS rule FROM told_once WHERE first_rule IS NOT NULL",
    "strict_ledger_summary": f"WITH {_LINES_SQL} SELECT ledger, count(*) AS n_lines, count(*) FILTER (first_rule IS NULL) AS n_events, count(DISTINCT first_rule) AS n_rules FROM told_once GROUP BY 1",
    "ledger_attestation": f"WITH {_ORDERS}, {_digest('lines', 'd')} SELECT * FROM d",
    "ledger_extension": f"""WITH {_ORDERS}, old AS (
  SELECT ledger, place, line FROM (SELECT *, max(place) OVER (PARTITION BY ledger) AS last FROM lines) WHERE place <= last - ledger % 3 OR place = 1
), new AS (
  SELECT ledger, place, CASE WHEN ledger % 5 = 3 AND place = 2 THEN line || '!' ELSE line END AS line FROM lines WHERE (ledger % 7 <> 1 OR place <= 2) AND ledger % 11 <> 2
), o AS (SELECT ledger, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS t FROM old GROUP BY 1),
s AS (SELECT n.ledger, count(*) AS n, sum(strlen(line) + 1) AS b, string_agg(line, chr(10) ORDER BY place) FILTER (place <= o.n) AS t FROM new n JOIN o ON o.ledger = n.ledger GROUP BY 1)
SELECT o.ledger, CASE WHEN s.n IS NULL THEN 'missing' WHEN s.b > 700 THEN 'too large' WHEN s.n < o.n THEN 'shorter' WHEN s.t <> o.t THEN 'changed' WHEN s.n = o.n THEN 'same' ELSE 'extended' END AS verdict
FROM o LEFT JOIN s USING (ledger)""",
    "ledger_disagreements": f"""WITH {_ORDERS}, said AS (SELECT ledger, place + (ledger % 13 = 5)::INT AS place, line AS e FROM lines WHERE ledger % 9 <> 4 OR place <> 3)
SELECT ledger, place AS line_number, CASE WHEN line IS NULL THEN 'no such line' WHEN e IS NULL THEN 'no event' ELSE 'differs' END AS problem
FROM lines FULL JOIN said USING (ledger, place) WHERE line IS DISTINCT FROM e""",
    "ledger_append": f"""WITH {_LINES_SQL}, held AS (SELECT * FROM told_once WHERE line_number % 3 <> 0 AND first_rule IS NULL),
more AS (SELECT * FROM told WHERE line_number % 3 = 0),
fine AS (SELECT *, rule IS NULL AND ledger <> 'signup' AND NOT EXISTS (SELECT 1 FROM held h WHERE h.ledger = more.ledger AND h.own = more.own)
  AND line_number = min(line_number) FILTER (rule IS NULL OR rule = 'not canonical') OVER (PARTITION BY ledger, own) AS ok FROM more),
n AS (SELECT ledger, count(*) AS n FROM held GROUP BY 1), a AS (SELECT ledger, count(*) FILTER (ok) AS added, nullif(count(*) FILTER (NOT ok), 0) AS refused FROM fine GROUP BY 1)
SELECT ledger, n + coalesce(added, 0) AS n_lines, n + coalesce(added, 0) AS last, refused AS n_refused FROM n LEFT JOIN a USING (ledger)""",
    "lineage_errors": f"""WITH RECURSIVE {LEDGER_SQL}, e AS (
  SELECT *, lead(id) OVER w AS following, row_number() OVER w AS i, floor(value / 100)::BIGINT::VARCHAR AS c FROM ledger WINDOW w AS (PARTITION BY subject ORDER BY created_at, id)
), f AS (
  SELECT *, CASE WHEN id % 101 = 0 THEN coalesce(following, prior) WHEN id % 211 = 0 THEN NULL WHEN id % 89 = 0 THEN -1 ELSE prior END AS up FROM e
), r AS (
  SELECT *, CASE WHEN id % 97 = 0 OR up IS NULL THEN 'ADD' WHEN id % 5 = 0 THEN 'RETRACT' ELSE 'SUPERSEDE' END AS action, id % 83 <> 0 AND up IS NOT NULL AS refers FROM f
), own AS (
  SELECT r.subject, r.id, CASE
    WHEN r.up IS NULL THEN CASE WHEN r.action <> 'ADD' OR r.refers THEN 'root-action' END
    WHEN r.action = 'ADD' THEN 'successor-action' WHEN p.id IS NULL OR p.i >= r.i THEN 'orphan-predecessor'
    WHEN NOT r.refers OR r.created_at < p.created_at THEN 'predecessor-contract'
    WHEN r.action = 'RETRACT' AND (p.action = 'RETRACT' OR r.c <> p.c) THEN 'retraction-contract'
    WHEN r.action = 'SUPERSEDE' AND p.action <> 'RETRACT' AND r.c = p.c THEN 'redundant-successor' END AS problem, p.id AS above, p.i >= r.i AS turns
  FROM r LEFT JOIN r p ON p.subject = r.subject AND p.id = r.up
), heads AS (
  SELECT subject FROM (SELECT subject, up, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY subject HAVING coalesce(max(n) FILTER (up IS NULL), 0) <> 1 OR max(n) FILTER (up IS NOT NULL) > 1
), suspects AS (SELECT subject, id, above FROM own WHERE subject IN (SELECT subject FROM own WHERE turns)),
walk(subject, id, place) AS (SELECT subject, id, above FROM suspects WHERE above IS NOT NULL UNION SELECT w.subject, w.id, s.above FROM walk w JOIN suspects s ON s.subject = w.subject AND s.id = w.place WHERE s.above IS NOT NULL),
cycles AS (SELECT subject, id FROM walk WHERE place = id)
SELECT subject AS logical_key, id::VARCHAR AS id, problem FROM own WHERE problem IS NOT NULL
UNION ALL SELECT subject, '', 'multiple-heads' FROM heads
UNION ALL SELECT subject, id::VARCHAR, 'supersession-cycle' FROM cycles
UNION ALL SELECT DISTINCT w.subject, w.id::VARCHAR, 'disconnected-lineage' FROM walk w JOIN cycles c ON c.subject = w.subject AND c.id = w.place WHERE NOT EXISTS (SELECT 1 FROM cycles d WHERE d.subject = w.subject AND d.id = w.id)""",
    "lineage_guards": f"""WITH {LEDGER_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY created_at, id) AS place, count(*) OVER (PARTITION BY subject) AS n FROM ledger)
SELECT subject AS logical_key, bool_or(user_id % 2 = 0) AS tool_descendant, bool_or(user_id % 2 <> 0) AS higher_descendant FROM p WHERE n > 1 + user_id % 6 GROUP BY 1""",
}

"""Keeping a projection in order: drift repair, maintenance plans, procedure recall and receipts, sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import top

#: The kinds of issues in the order of a plan, and how many issues, ids and paths it holds.
ISSUE_KINDS = ("evidence-gap", "exact-content-overlap", "scope-not-in-map", "source-not-in-map", "source-changed")
MOST_ISSUES, MOST_IDS, MOST_PATHS = 256, 32, 32


def drifted(expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, action, changed``: what makes a projection equal to what the ledger says.

    ``insert`` where a row is missing, ``rewrite`` where columns differ (``changed`` names them,
    in the order given), ``remove`` where the ledger has no such row. Two nulls are equal, and
    arrays are compared as sets in order. Rows that agree don't appear.
    """
    side = lambda df, mark: df.select(key, F.lit(True).alias(mark), *[_canonical(df, c).alias(f"{mark}_{c}") for c in columns])
    both = side(expected, "e").join(side(actual, "a"), key, "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), c) for c in columns]))
    action = F.when(F.col("a").isNull(), "insert").when(F.col("e").isNull(), "remove").when(F.size(differs) > 0, "rewrite")
    none = F.array().cast("array<string>")
    return both.select(key, action.alias("action"), F.when(action == "rewrite", differs).otherwise(none).alias("changed")).where("action IS NOT NULL")


def _canonical(df: DataFrame, column: str) -> Column:
    return F.array_sort(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)


def repaired(expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``actual`` after the repair: rows that drifted replaced, missing ones added, unknown ones removed."""
    todo = drifted(expected, actual, key, columns)
    names = actual.columns
    kept = actual.join(todo.select(key), key, "left_anti").select(*names)
    return kept.unionByName(expected.join(todo.where("action <> 'remove'").select(key), key, "left_semi").select(*names))


def is_no_op(expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str]) -> bool:
    """Whether nothing has to be written: every row is there and agrees."""
    return drifted(expected, actual, key, columns).isEmpty()


def maintenance_plan(issues: DataFrame, limit: int = MOST_ISSUES) -> DataFrame:
    """``place, kind, memory_ids, ids_omitted, paths, paths_omitted``: the first issues in order of kind and hash.

    ``issues`` has ``kind`` and the arrays ``memory_ids, paths``. The hash is of kind, ids and
    paths; lists are sorted and cut to 32. The bounds are the feature; :func:`issue_counts`
    tells how much they leave out.
    """
    ids, paths = F.array_sort(F.array_distinct("memory_ids")), F.array_sort(F.array_distinct("paths"))
    rows = issues.select("kind", ids.alias("_ids"), paths.alias("_paths")).where(F.col("kind").isin(*ISSUE_KINDS)).distinct()
    order = F.array_position(F.array(*map(F.lit, ISSUE_KINDS)), F.col("kind"))
    name = F.sha2(F.concat_ws("|", "kind", F.array_join("_ids", ","), F.array_join("_paths", ",")), 256)
    first = top(rows.withColumns({"_o": order, "_h": name}), limit, F.asc("_o"), F.asc("_h"))
    listed = first.agg(F.array_sort(F.collect_list(F.struct("_o", "_h", "kind", "_ids", "_paths"))).alias("xs"))  # at most ``limit`` rows
    each = listed.select(F.posexplode("xs").alias("place", "x"))
    return each.select(
        (F.col("place") + 1).cast("long").alias("place"), "x.kind",
        F.slice("x._ids", 1, MOST_IDS).alias("memory_ids"), F.greatest(F.size("x._ids") - MOST_IDS, F.lit(0)).cast("long").alias("ids_omitted"),
        F.slice("x._paths", 1, MOST_PATHS).alias("paths"), F.greatest(F.size("x._paths") - MOST_PATHS, F.lit(0)).cast("long").alias("paths_omitted"),
    )


def issue_counts(issues: DataFrame, plan: DataFrame) -> DataFrame:
    """``kind, total, emitted, omitted`` of every kind that has an issue."""
    ids, paths = F.array_sort(F.array_distinct("memory_ids")), F.array_sort(F.array_distinct("paths"))
    whole = issues.select("kind", ids.alias("i"), paths.alias("p")).where(F.col("kind").isin(*ISSUE_KINDS)).distinct().groupBy("kind").agg(F.count("*").alias("total"))
    shown = plan.groupBy("kind").agg(F.count("*").alias("emitted"))
    emitted = F.coalesce("emitted", F.lit(0)).cast("long")
    return whole.join(shown, "kind", "left").select("kind", "total", emitted.alias("emitted"), (F.col("total") - emitted).alias("omitted"))


def task_selectors(plan: DataFrame, place: int, heads: DataFrame) -> tuple[list[str], list[str]]:
    """Memory ids and paths of a plan's task, for an exact context query; an id that is no head now is an error."""
    row = plan.where(F.col("place") == place).select("memory_ids", "paths").first()
    if row is None:
        raise ValueError(f"the plan has no task {place}")
    ids = [str(i) for i in row["memory_ids"]]
    known = {str(r["memory_id"]) for r in heads.where(F.col("memory_id").cast("string").isin(ids)).select("memory_id").collect()}  # at most 32
    if set(ids) - known:
        raise ValueError(f"no head now: {sorted(set(ids) - known)}")
    return ids, list(row["paths"])


def recalled_procedures(procedures: DataFrame, states: DataFrame, query: str, ids: Sequence = (), paths: Sequence[str] = ()) -> DataFrame:
    """``id, relevance, state, prior``: the procedures that a query calls for, most relevant first.

    ``procedures`` has ``id, title, goal, triggers, applies_to, importance``; ``states`` is what
    ``context.procedure_states`` gives. A procedure that is named, or applies to a named path,
    has relevance 2; else it is the share of the query's words among its own, of which a query
    of several words must find two. Ordered by relevance, prior and id.
    """
    terms = T.query_terms(query)
    words = T.words(F.concat_ws(" ", "title", "goal", F.array_join("triggers", " ")))
    matches = F.size(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, terms)))) if terms else F.lit(0)
    exact = F.col("id").isin(*ids) if ids else F.lit(False)
    if paths:
        exact = exact | F.arrays_overlap("applies_to", F.array(*map(F.lit, paths)))
    rows = procedures.select("id", "importance", F.coalesce(exact, F.lit(False)).alias("exact"), matches.alias("matches"))
    rows = rows.where(F.col("exact") | (F.col("matches") >= (2 if len(terms) > 1 else 1)))
    relevance = F.when(F.col("exact"), 2.0).otherwise(F.col("matches") / F.lit(max(len(terms), 1)))
    joined = rows.join(states.select("id", "state", F.col("prior").alias("_p")), "id")
    out = joined.select("id", relevance.alias("relevance"), "state", (F.col("_p") + F.col("importance") * 0.01).alias("prior"))
    return out.orderBy(F.desc("relevance"), F.desc("prior"), F.asc("id"))


def receipt_errors(outcomes: DataFrame, procedures: DataFrame) -> DataFrame:
    """``outcome_id, errors``: receipts that must not be written.

    ``outcomes`` has ``outcome_id, procedure_id, receipt_id, episode_id, created_at``;
    ``procedures`` has ``id, approved, created_at``. The target must be an approved version and
    not be younger than the outcome; of outcomes with one receipt or episode only the first stands.
    """
    target = procedures.select(F.col("id").alias("procedure_id"), "approved", F.col("created_at").alias("_born"))
    rows = outcomes.join(target, "procedure_id", "left")
    for name in ("receipt_id", "episode_id"):
        first = outcomes.groupBy(name).agg(F.min_by("outcome_id", F.struct("created_at", "outcome_id")).alias(f"_{name}"))
        rows = rows.join(first, name, "left")
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce("approved", F.lit(False)), "no approved version"),
            F.when(F.col("created_at") < F.col("_born"), "predates its version"),
            F.when(F.col("_receipt_id") != F.col("outcome_id"), "duplicate receipt"),
            F.when(F.col("_episode_id") != F.col("outcome_id"), "duplicate episode"),
        )
    )
    return rows.select("outcome_id", errors.alias("errors")).where(F.size("errors") > 0)


def source_reference(text: Column) -> Column:
    """A source given as JSON text: an object with type and id as it is, a plain string as a source of type uri; else null."""
    parsed = F.from_json(text, "type string, id string, title string, uri string")
    plain = F.struct(F.lit("uri").alias("type"), text.alias("id"), F.lit(None).cast("string").alias("title"), text.alias("uri"))
    named = parsed["type"].isNotNull() & parsed["id"].isNotNull()
    return F.when(F.ltrim(text).startswith("{"), F.when(named, parsed)).when(F.trim(text) != "", plain)

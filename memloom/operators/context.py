"""From ranked records to a prompt: budgets, assembly, procedures, maintenance, model choice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ledger import saved
from .records import overview_or_default
from .triggers import lookup

#: Model tiers from the cheapest on.
TIERS = ("fast", "balanced", "powerful")


def _packed(items: Column, budget: Column, size: str, skip: bool) -> Column:
    """Sizes are taken in order while they fit; a size that doesn't is skipped or ends the fold."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"), F.expr("cast(array() as array<string>)").alias("ids"))

    def step(at: Column, x: Column) -> Column:
        fits = at["open"] & (at["used"] + x[size] <= budget)
        return F.struct(
            F.when(fits, at["used"] + x[size]).otherwise(at["used"]).alias("used"),
            (at["open"] if skip else fits).alias("open"),
            F.when(fits, F.concat(at["ids"], F.array(x["id"].cast("string")))).otherwise(at["ids"]).alias("ids"),
        )

    return F.aggregate(items, start, step)


def greedy_budget(candidates: DataFrame, group: Sequence[str], total: int, system: int = 0, user: int = 0, candidates_each: int = 1000) -> DataFrame:
    """``group, selected, used, remaining``: the most valuable candidates that fit the tokens left.

    ``candidates`` has ``id, tokens, score, importance``. They are tried by 0.6 score + 0.4
    importance, and one that is too large is passed over. They are gathered in rounds of at
    most ``candidates_each`` of a group: the best of those that come later and fit what is left.
    One that doesn't fit by then never will, so the rounds end with all candidates tried. A
    column ``room`` of the candidates, equal within a group, is the group's budget if it is there.
    """
    value = F.round(0.6 * F.col("score") + 0.4 * F.col("importance"), 9)
    room = F.col("room") if "room" in candidates.columns else F.lit(max(0, total - system - user))
    names = [f"_g{i}" for i in range(len(group))]
    keys = [F.col(g).alias(n) for g, n in zip(group, names, strict=True)]
    place = F.struct(value.isNull().alias("none"), (-value).alias("value"), "id", F.monotonically_increasing_id().alias("row"))
    placed = saved(candidates.select(*keys, "id", F.col("tokens").cast("long").alias("tokens"), place.alias("place"), room.cast("long").alias("room")))
    state = placed.groupBy(*names).agg(
        F.max("room").alias("room"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<string>)").alias("ids"), F.lit(None).cast(placed.schema["place"].dataType).alias("last")
    )
    next_ones = Window.partitionBy(*names).orderBy("place")
    while True:
        seen = state.select(*[F.col(n).alias(f"{n}s") for n in names], (F.col("room") - F.col("used")).alias("left"), "last")
        same = [F.col(n).eqNullSafe(F.col(f"{n}s")) for n in names] or [F.lit(True)]
        later = placed.join(seen, reduce(lambda x, y: x & y, same)).where("(last IS NULL OR place > last) AND tokens <= left").select(*placed.columns, "left")
        best = later.withColumn("k", F.row_number().over(next_ones)).where(F.col("k") <= candidates_each)
        items = F.array_sort(F.collect_list(F.struct("place", "id", "tokens")))
        gathered = saved(best.groupBy(*names).agg(items.alias("items"), F.first("left").alias("left"), F.max("place").alias("reached")))
        if gathered.isEmpty():
            break
        more = gathered.select(
            *[F.col(n).alias(f"{n}s") for n in names], _packed(F.col("items"), F.col("left"), "tokens", skip=True).alias("p"), "reached"
        )
        state = saved(
            state.join(more, reduce(lambda x, y: x & y, same), "left").select(
                *names,
                "room",
                (F.col("used") + F.coalesce("p.used", F.lit(0))).alias("used"),
                F.when(F.col("p").isNull(), F.col("ids")).otherwise(F.concat("ids", "p.ids")).alias("ids"),
                F.coalesce("reached", "last").alias("last"),
            )
        )
    return state.select(
        *[F.col(n).alias(g) for g, n in zip(group, names, strict=True)],
        F.array_join("ids", ",").alias("selected"), "used", (F.col("room") - F.col("used")).alias("remaining"),
    )


def agent_context(records: DataFrame, max_characters: int, limit: int = 50) -> DataFrame:
    """One row ``context, n_records, tokens``: blocks of the best records within a size.

    ``records`` has ``memory_id, kind, title, content, score``. The last block is cut if 120
    characters or more are left for it, two of which each separator takes.
    """
    top = records.orderBy(F.desc("score"), F.asc("memory_id")).limit(limit)
    block = F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.col("content"))
    rows = top.select((-F.col("score")).alias("o"), "memory_id", block.alias("b"))
    items = rows.agg(F.array_sort(F.collect_list(F.struct("o", "memory_id", "b"))).alias("items"))  # at most ``limit`` rows
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(at: Column, x: Column) -> Column:
        gap = F.when(at["n"] > 0, F.lit(2)).otherwise(F.lit(0))
        left = F.lit(max_characters) - F.length(at["text"]) - gap
        whole = at["open"] & (F.length(x["b"]) <= left)
        part = at["open"] & ~whole & (left >= 120)
        piece = F.when(whole, x["b"]).when(part, F.substring(x["b"], F.lit(1), left))
        joined = F.concat(at["text"], F.when(at["n"] > 0, "\n\n").otherwise(""), piece)
        return F.struct(
            F.coalesce(joined, at["text"]).alias("text"), (at["n"] + F.when(whole | part, 1).otherwise(0)).alias("n"), whole.alias("open")
        )

    done = items.select(F.aggregate("items", start, step).alias("p"))
    return done.select(
        F.col("p.text").alias("context"), F.col("p.n").cast("long").alias("n_records"),
        F.greatest(F.lit(1), F.floor(F.length("p.text") / 4)).cast("long").alias("tokens"),
    )


def prompt(records: DataFrame, group: Sequence[str], system: str, user: str) -> DataFrame:
    """``group, prompt, tokens``: tagged sections with the group's records by ``place``.

    ``records`` has ``place, kind, score, title, content`` and is a top-k list of each group.
    """
    line = F.format_string("\n[#%d] (%s, score=%.2f) %s\n%s", F.col("place"), "kind", "score", "title", "content")
    parts = records.select(*group, F.struct("place", line.alias("t")).alias("x")).groupBy(*group).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["t"]), "")
    text = F.concat(
        F.lit(f"<system>\n{system}\n</system>\n\n<memories>"), body, F.lit(f"\n</memories>\n\n<user>\n{user}\n</user>")
    )
    return parts.select(*group, text.alias("prompt")).withColumn("tokens", T.word_tokens(F.col("prompt")))


def preflight(
    messages: DataFrame, records: DataFrame, index: DataFrame, overviews: DataFrame, as_of: str, system: str, total: int, keys: Sequence[str]
) -> DataFrame:
    """From message to prompt, a row a message: ``keys, called, summary, selected, used, remaining, prompt``.

    ``messages`` has ``keys, tenant_id, project_id, text``. The records that its phrases call up
    (``index``, as ``triggers.lookup`` takes it) are candidates with that score; of them a
    greedy budget keeps what fits beside system text and message (words times 1.3). The prompt has the overview
    kept for the project, or the default, then the selected records in the order of their value.
    ``records`` has ``memory_id, kind, title, content, importance``.
    """
    own = [F.col(k) for k in keys]
    called = lookup(messages, index, list(keys), "text").groupBy(*own, "memory_id").agg(F.max("score").alias("score"))
    sized = records.select("memory_id", "kind", "title", "content", "importance", T.word_tokens(F.col("content")).alias("tokens"))
    room = F.greatest(F.lit(0), F.lit(total) - T.word_tokens(F.lit(system)) - T.word_tokens(F.col("text"))).cast("long").alias("room")
    found = saved(called.join(sized.select("memory_id", "importance", "tokens"), "memory_id").join(messages.select(*own, room), list(keys)))
    budget = greedy_budget(found.withColumn("id", F.col("memory_id").cast("string")), keys, total)

    ids = F.filter(F.split("selected", ","), lambda x: x != "")
    chosen = budget.select(*own, F.explode(ids).alias("_id")).join(found.withColumn("_id", F.col("memory_id").cast("string")), [*keys, "_id"])
    shown = chosen.join(sized.select("memory_id", "kind", "title", "content"), "memory_id")
    value = F.round(0.6 * F.col("score") + 0.4 * F.col("importance"), 9)
    line = F.concat(F.lit("] ("), "kind", F.format_string(", score=%.2f) ", F.col("score")), F.coalesce("title", F.lit("")), F.lit("\n"), "content")
    lines = shown.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct((-value).alias("v"), F.col("_id").alias("id"), line.alias("t")))).alias("_lines"))

    hits = called.groupBy(*own).agg(F.count("*").alias("called"))
    kept = overview_or_default(messages.select("tenant_id", "project_id").distinct(), overviews, as_of)
    out = messages.select(*own, "tenant_id", "project_id", "text", room).join(kept, ["tenant_id", "project_id"])
    for more in (hits, budget.drop("remaining"), lines):
        out = out.join(more, list(keys), "left")
    body = F.array_join(F.transform("_lines", lambda x, i: F.concat(F.lit("\n[#"), (i + 1).cast("string"), x["t"])), "")
    text = F.concat(
        F.lit(f"<system>\n{system}\n</system>\n\n<overview>\n"), "summary", F.lit("\n</overview>\n\n<memories>"), F.coalesce(body, F.lit("")),
        F.lit("\n</memories>\n\n<user>\n"), "text", F.lit("\n</user>"),
    )
    none = F.lit(0).cast("long")
    return out.select(
        *own, F.coalesce("called", none).alias("called"), "summary", F.coalesce("selected", F.lit("")).alias("selected"),
        F.coalesce("used", none).alias("used"), (F.col("room") - F.coalesce("used", none)).alias("remaining"), text.alias("prompt"),
    )


def procedure_states(procedures: DataFrame, receipts: DataFrame) -> DataFrame:
    """``id, state, successes, failures, prior``: the latest receipt decides.

    ``procedures`` has ``id, approved, source_hash, current_hash``; ``receipts`` has
    ``procedure_id, outcome, position``. The prior is (successes + 1) / (all + 2).
    """
    seen = receipts.groupBy(F.col("procedure_id").alias("id")).agg(
        F.max_by("outcome", "position").alias("last"), F.count_if(F.col("outcome") == "success").alias("successes"),
        F.count_if(F.col("outcome") == "failure").alias("failures"),
    )
    joined = procedures.join(seen, "id", "left").fillna(0, ["successes", "failures"])
    state = (
        F.when(~F.col("approved"), "candidate").when(F.col("source_hash") != F.col("current_hash"), "stale")
        .when(F.col("last") == "failure", "failed").when(F.col("last") == "success", "ready").otherwise("unverified")
    )
    prior = (F.col("successes") + 1) / (F.col("successes") + F.col("failures") + 2)
    return joined.select("id", state.alias("state"), "successes", "failures", prior.alias("prior"))


def maintenance_issues(records: DataFrame, files: DataFrame, scan_complete: bool = True) -> DataFrame:
    """``memory_id, kind``: evidence gaps, sources not in the map or changed, exact overlaps.

    ``records`` has ``memory_id, path, source_hash, fingerprint``; ``files`` has ``path, sha256``.
    Without a complete scan the path checks are deferred.
    """
    gaps = records.where("path IS NULL").select("memory_id", F.lit("evidence-gap").alias("kind"))
    cited = records.where("path IS NOT NULL").join(files.select("path", "sha256"), "path", "left")
    hexed = lambda c: F.col(c).rlike("^[0-9a-f]{64}$")
    kind = (
        F.when(F.col("sha256").isNull(), "source-not-in-map")
        .when(hexed("sha256") & hexed("source_hash") & (F.col("sha256") != F.col("source_hash")), "source-changed")
    )
    checked = cited.select("memory_id", kind.alias("kind")).where("kind IS NOT NULL")
    if not scan_complete:
        checked = checked.withColumn("kind", F.lit("deferred"))
    twice = records.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    overlap = records.join(twice, "fingerprint", "left_semi").select("memory_id", F.lit("exact-content-overlap").alias("kind"))
    return gaps.unionByName(checked).unionByName(overlap)


def model_routes(requests: DataFrame, models: DataFrame) -> DataFrame:
    """``request_id, model``: the cheapest capable model of the nearest tier, dearer tiers first.

    ``requests`` has ``request_id, task, tier``; ``models`` has ``model, tier, cost, tasks``. Of
    each task and tier only the cheapest model is joined, three a task at most.
    """
    place = F.create_map(*[F.lit(x) for pair in ((t, i) for i, t in enumerate(TIERS)) for x in pair])
    each = models.select("model", F.element_at(place, F.col("tier")).alias("have"), "cost", F.explode("tasks").alias("task"))
    best = each.groupBy("task", "have").agg(F.min(F.struct("cost", "model")).alias("b"))
    best = best.groupBy("task").agg(F.collect_list(F.struct("have", "b")).alias("_tiers"))
    want = F.element_at(place, F.col("tier"))
    far = lambda have: F.when(have >= want, 2 * (have - want) - 1).otherwise(2 * (want - have))
    nearest = F.array_min(F.transform("_tiers", lambda t: F.struct(far(t["have"]).alias("far"), t["b"]["cost"].alias("cost"), t["b"]["model"].alias("model"))))
    return requests.join(best, "task", "left").select("request_id", nearest["model"].alias("model"))

"""How a store and a repository are doing: counts, states, summaries, staleness, checks and the boot brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repo_graph import node_id

#: States and layers that are counted, and the tables of a tenant's rows.
STATES = ("active", "superseded", "deleted", "retracted")
LAYERS = ("conversation", "session", "user", "agent", "organization")
#: Entities and decisions that a summary names, and entities that its text does.
TOP_ENTITIES, TOP_DECISIONS, NAMED = 20, 10, 5
#: Bytes that a boot brief may have.
MOST_BRIEF = 12_000


def storage_overview(records: DataFrame, tables: dict[str, DataFrame], shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """``tenant_id`` and a count for each state, layer and table, in one pass over each.

    ``records`` has ``memory_id, tenant_id, status, held, memory_layer`` and ``embedding`` if
    any. ``tables`` have ``tenant_id``, or ``memory_id`` whose tenant counts; ``shared`` ones
    belong to all. A tenant without records that has rows elsewhere is listed too.
    """
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = [F.count("*").alias("memories_total")]
    counts += [flag(F.col("status") == s).alias(f"memories_{s}") for s in STATES]
    counts += [flag(F.col("held")).alias("memories_held")]
    counts += [flag(F.col("memory_layer") == x).alias(f"{x}_layer_total") for x in LAYERS]
    if "embedding" in records.columns:
        counts.append(flag(F.size("embedding") > 0).alias("vectorized_memories"))
    out = records.groupBy("tenant_id").agg(*counts)
    owner = records.select("memory_id", "tenant_id")
    rows: DataFrame | None = None
    for name, df in tables.items():
        own = df if "tenant_id" in df.columns else df.select("memory_id").join(owner, "memory_id")
        n = own.groupBy("tenant_id").agg(F.count("*").alias("n")).select("tenant_id", F.lit(name).alias("name"), "n")
        rows = n if rows is None else rows.unionByName(n)
    if rows is not None:
        wide = rows.groupBy("tenant_id").agg(*[F.sum(F.when(F.col("name") == t, F.col("n"))).alias(f"{t}_total") for t in tables])
        out = out.join(wide, "tenant_id", "full_outer")
    names = [c for c in out.columns if c != "tenant_id"]
    out = out.fillna(0, names)
    for name, df in (shared or {}).items():
        out = out.join(F.broadcast(df.agg(F.count("*").alias(f"{name}_total"))))  # one row
    return out


def storage_states(records: DataFrame, sources: DataFrame, connected: DataFrame, triggers: DataFrame, relations: DataFrame, audit: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per record what is stored of it: five counts, its vector's length, and whether two indexes have it.

    All but ``relations`` (``src, dst``) and ``connected`` (``source_id``, joined to that of
    ``sources``) have ``memory_id``. Each table is counted by record before it is joined. A
    relation of a record to itself counts once.
    """
    count = lambda df, name: df.groupBy("memory_id").agg(F.count("*").alias(name))
    links = sources.select("memory_id", "source_id").distinct().join(connected.select("source_id").distinct(), "source_id", "left_semi")
    ends = relations.select(F.col("src").alias("memory_id")).unionAll(relations.where("src <> dst").select(F.col("dst").alias("memory_id")))
    parts = [
        count(sources, "source_reference_count"), count(links, "connected_source_count"), count(triggers, "trigger_phrase_count"),
        count(ends, "relation_count"), count(audit, "audit_event_count"),
        indexed.select("memory_id").distinct().withColumn("fts_indexed", F.lit(True)),
    ]
    size = F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0)) if "embedding" in records.columns else F.lit(0)
    out = records.select("memory_id", "fingerprint", size.cast("long").alias("embedding_dimensions"))
    for part in parts:
        out = out.join(part, "memory_id", "left")
    counts = ["source_reference_count", "connected_source_count", "trigger_phrase_count", "relation_count", "audit_event_count"]
    out = out.fillna(0, counts).fillna(False, ["fts_indexed"])
    return out.withColumn("trigger_indexed", F.col("trigger_phrase_count") > 0)


def _ranked(counts: DataFrame, keys: list[str], name: str, most: int | None = None) -> DataFrame:
    """``keys`` and an array of structs ``(name, n)``, the most frequent first, then the one met first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first", name)
    rows = counts.withColumn("_k", F.row_number().over(order))
    rows = rows if most is None else rows.where(F.col("_k") <= most)
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", name, "n"))).alias("_items"))
    return gathered.withColumn("_items", F.transform("_items", lambda x: F.struct(x[name].alias("name"), x["n"].alias("n"))))


def project_overviews(records: DataFrame, keys: list[str], newest: int | None = None) -> DataFrame:
    """Per project ``summary, key_entities, recent_decisions, active_memory_count``.

    ``records`` has ``keys, memory_id, kind, title, content, entity_keys, updated_at``; with
    ``newest``, only so many of a project are told of. Ties of counts go to what was met first
    from the newest record on. A decision without a title is told by its first 80 characters.
    """
    recency = Window.partitionBy(*keys).orderBy(F.desc("updated_at"), F.asc("memory_id"))
    rows = records.withColumn("_r", F.row_number().over(recency))
    rows = rows if newest is None else rows.where(F.col("_r") <= newest)
    kinds = rows.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.min("_r").cast("long").alias("first"))
    each = rows.select(*keys, "_r", F.posexplode("entity_keys").alias("_p", "entity"))
    entities = each.groupBy(*keys, "entity").agg(F.count("*").alias("n"), F.min(F.struct("_r", "_p")).alias("first"))
    title = F.coalesce("title", F.substring("content", 1, 80))
    decisions = rows.where("kind = 'decision'").withColumn("_k", F.row_number().over(recency)).where(F.col("_k") <= TOP_DECISIONS)
    told = decisions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", title.alias("t")))).alias("_told"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("active_memory_count"))
    out = out.join(_ranked(kinds, keys, "kind").withColumnRenamed("_items", "_kinds"), keys).join(_ranked(entities, keys, "entity", TOP_ENTITIES), keys, "left").join(told, keys, "left")
    none = F.array().cast("array<string>")
    names = F.coalesce(F.transform("_items", lambda x: x["name"]), none)
    parts = F.transform("_kinds", lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["name"], F.lit("s")))
    said = F.concat(F.lit("Project has "), F.array_join(F.concat(F.array(F.concat(F.col("active_memory_count").cast("string"), F.lit(" memories"))), parts), ", "), F.lit("."))
    named = F.when(F.size(names) > 0, F.concat(F.lit(" Key entities: "), F.array_join(F.slice(names, 1, NAMED), ", "), F.lit("."))).otherwise("")
    return out.select(*keys, F.concat(said, named).alias("summary"), names.alias("key_entities"), F.coalesce(F.transform("_told", lambda x: x["t"]), none).alias("recent_decisions"), "active_memory_count")


def artifact_states(manifest: DataFrame, found: DataFrame, most_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """``path, state`` of the artifacts that a manifest names: current, missing, changed or invalid.

    Both have ``path, bytes, sha256``. An entry without a usable path, size or hash is invalid,
    whatever is there.
    """
    there = found.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    path = F.col("path")
    usable = path.rlike(r"^[^/]") & ~path.rlike(r"(^|/)\.{0,2}(/|$)|^[A-Za-z]:") & F.col("bytes").between(0, most_bytes) & F.col("sha256").rlike("^[0-9a-f]{64}$")
    state = (
        F.when(~F.coalesce(usable, F.lit(False)), "invalid").when(F.col("_h").isNull(), "missing")
        .when((F.col("_b") != F.col("bytes")) | (F.col("_h") != F.col("sha256")), "changed").otherwise("current")
    )
    return manifest.join(there, "path", "left").select("path", state.alias("state"))


def repository_status(manifests: DataFrame, sources: DataFrame, ledgers: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per repository whether its derived tables are those of its sources and ledger, and what it holds.

    ``manifests`` has ``repository, source_fingerprint, memory_fingerprint``; ``sources`` and
    ``ledgers`` the same as found now, with ``files, symbols`` and ``total, active``;
    ``artifacts`` has ``repository, state``. Without a manifest a repository isn't initialized.
    """
    bad = artifacts.where("state <> 'current'").groupBy("repository").agg(F.count("*").alias("stale_artifacts"))
    out = sources.withColumnRenamed("source_fingerprint", "_source").join(ledgers.withColumnRenamed("memory_fingerprint", "_memory"), "repository", "left")
    out = out.join(manifests, "repository", "left").join(bad, "repository", "left").fillna(0, ["stale_artifacts", "total", "active"])
    known = F.col("source_fingerprint").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(~known, "not initialized"), F.when(known & (F.col("source_fingerprint") != F.col("_source")), "sources changed"),
            F.when(known & ~F.col("memory_fingerprint").eqNullSafe(F.col("_memory")), "ledger changed"), F.when(F.col("stale_artifacts") > 0, "artifacts changed"),
        )
    )
    return out.select("repository", (F.size(reasons) == 0).alias("current"), F.array_join(reasons, "; ").alias("reasons"), "files", "symbols", "active", "total")


def graph_checks(nodes: DataFrame, edges: DataFrame, expected_nodes: DataFrame, expected_edges: DataFrame, manifest: DataFrame, ledger: DataFrame, graph: DataFrame) -> DataFrame:
    """``check, passed`` of the stored graph, map, manifest and ledger, by name.

    ``nodes`` has ``id, type, path, valid_from``, ``edges`` ``id, src, dst, type, effective_at``;
    the expected ones are built anew from the map and the ledger. ``manifest`` has ``path, bytes,
    sha256``; ``ledger`` (one row) ``bytes, memory_fingerprint, found_bytes, found_fingerprint``;
    ``graph`` (one row) the fingerprints ``source, memory, projection`` that the graph states and
    ``map_source, manifest_source, manifest_memory`` that the others do.
    """
    none = lambda df: df.agg((F.count("*") == 0).alias("passed"))
    ids, before = nodes.select("id"), nodes.where("type = 'memory'").select(F.col("id").alias("src"), "valid_from")
    twice = ids.unionByName(edges.select("id")).groupBy("id").count().where("count > 1")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).join(ids, "id", "left_anti")
    odd = nodes.where("type = 'memory'").where("valid_from IS NULL OR id NOT LIKE 'memory:%' OR path IS NOT NULL")
    times = edges.join(before, "src", "left").where("NOT (effective_at <=> valid_from)")
    differ = lambda a, b, columns: none(a.select(*columns).exceptAll(b.select(*columns)).unionByName(b.select(*columns).exceptAll(a.select(*columns))))
    shape, line = ["id", "type", "path"], ["src", "dst", "type"]
    ledger_entry = manifest.where("path = 'memory/events'").agg(F.count("*").alias("n"), F.max("sha256").alias("h"), F.max("bytes").alias("b"))
    attested = ledger_entry.join(F.broadcast(ledger)).select(((F.col("n") == 1) & (F.col("h") == F.col("memory_fingerprint")) & (F.col("b") == F.col("bytes"))).alias("passed"))
    projection = F.sha2(F.concat_ws("\u0000", "source", "memory"), 256)
    checks = {
        "stored-manifest-artifact-set": none(manifest.groupBy("path").count().where("count > 1")),
        "stored-memory-snapshot": ledger.select(((F.col("bytes") == F.col("found_bytes")) & (F.col("memory_fingerprint") == F.col("found_fingerprint"))).alias("passed")),
        "stored-ledger-attestation": attested,
        "stored-source-fingerprint": graph.select(((F.col("source") == F.col("map_source")) & (F.col("source") == F.col("manifest_source"))).alias("passed")),
        "stored-graph-identities": none(twice),
        "stored-graph-references": none(ends),
        "stored-memory-fingerprint": graph.join(F.broadcast(ledger.select("memory_fingerprint"))).select(((F.col("memory") == F.col("manifest_memory")) & (F.col("memory") == F.col("memory_fingerprint"))).alias("passed")),
        "stored-projection-fingerprint": graph.select((F.col("projection") == projection).alias("passed")),
        "stored-temporal-nodes": none(odd),
        "stored-temporal-edges": none(times),
        "stored-canonical-nodes": differ(nodes, expected_nodes, shape),
        "stored-canonical-edges": differ(edges, expected_edges, line),
    }
    out: DataFrame | None = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("check"), F.coalesce("passed", F.lit(False)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def typed_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with ``id``, made from their ends and type."""
    return edges.withColumn("id", node_id("edge", F.col("type"), F.col("src"), F.col("dst")))


def _listed(rows: DataFrame, keys: list[str], line: Column, order: list[Column], most: int, empty: str, name: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = rows.select(*keys, place.alias("_k"), line.alias("_t")).where(F.col("_k") <= most)
    text = best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_t"))), lambda x: x["_t"]), "\n").alias(name))
    return text.withColumn(name, F.coalesce(name, F.lit(empty)))


def boot_briefs(repositories: DataFrame, folders: DataFrame, packages: DataFrame, commands: DataFrame, variables: DataFrame, key_files: DataFrame, most_bytes: int = MOST_BRIEF) -> DataFrame:
    """Per repository ``brief, fits``: a short Markdown page that an agent reads first, and whether it keeps to its bound.

    ``repositories`` has ``repository, description, files, symbols, nodes, edges, languages,
    active``; the others ``repository`` and ``directory, file_count``; ``path, name, ecosystem,
    n_dependencies``; ``command, cwd, source``; ``name, paths``; ``path, score``. Lists hold their
    first 15, 20, 30, 30 and 18.
    """
    keys, tick = ["repository"], lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    top = folders.where(~F.col("directory").contains("/") & (F.col("directory") != "."))
    parts = {
        "_folders": _listed(top, keys, F.concat(F.lit("- "), tick(F.concat("directory", F.lit("/"))), F.lit(" — "), F.col("file_count").cast("string"), F.lit(" files")), [F.desc("file_count"), F.asc("directory")], 15, "", "_folders"),
        "_packages": _listed(packages, keys, F.concat(F.lit("- "), tick(F.col("path")), F.lit(" — "), "name", F.lit(" ("), "ecosystem", F.lit("; "), F.col("n_dependencies").cast("string"), F.lit(" dependencies)")), [F.asc("path")], 20, "", "_packages"),
        "_commands": _listed(commands, keys, F.concat(F.lit("- "), tick(F.col("command")), F.lit(" from "), tick(F.col("cwd")), F.lit(" (declared by "), tick(F.col("source")), F.lit(")")), [F.asc("source"), F.asc("command")], 30, "", "_commands"),
        "_variables": _listed(variables, keys, F.concat(F.lit("- "), tick(F.col("name")), F.lit(" — "), F.array_join(F.transform("paths", tick), ", ")), [F.asc("name")], 30, "", "_variables"),
        "_files": _listed(key_files, keys, F.concat(F.lit("- "), tick(F.col("path"))), [F.desc("score"), F.asc("path")], 18, "", "_files"),
    }
    out = repositories
    for df in parts.values():
        out = out.join(df, "repository", "left")
    some = lambda c, empty: F.coalesce(c, F.lit(f"- _{empty}_"))
    number = lambda c: F.col(c).cast("string")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), "repository", F.lit(" repo brain")), F.lit(""), F.lit("## Repository"), F.lit(""),
        F.coalesce(F.concat(F.lit("Repository-declared description: "), "description"), F.concat("repository", F.lit(" repository"))), F.lit(""),
        F.concat(F.lit("- Files / symbols / graph: "), number("files"), F.lit(" / "), number("symbols"), F.lit(" / "), number("nodes"), F.lit(" nodes, "), number("edges"), F.lit(" edges")),
        F.concat(F.lit("- Languages: "), F.when(F.size("languages") > 0, F.array_join("languages", ", ")).otherwise("none detected")),
        F.concat(F.lit("- Active memories: "), number("active")),
        F.lit("\n## Repository map\n"), some("_folders", "Single-directory repository."), F.lit("\n## Packages and services\n"), some("_packages", "No supported package manifests detected."),
        F.lit("\n## Declared commands\n"), some("_commands", "No explicit package scripts or Make targets detected."), F.lit("\n## Environment contract\n"), some("_variables", "No declared environment-variable names detected."),
        F.lit("\n## Key files\n"), F.coalesce("_files", F.lit("")),
    )
    return out.select("repository", text.alias("brief")).withColumn("fits", F.octet_length("brief") <= most_bytes)

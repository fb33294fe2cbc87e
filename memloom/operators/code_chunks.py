"""Source files as chunks, and what is recorded of them: records, entities, relations.

Chunks are found by the shape of lines, an approximation without a syntax tree: a definition
begins a chunk, and it ends before the next line that stands no deeper. Depth is the number of
open braces before a line, or in Python its indent. All of it is sums and windows over the
lines of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Depths at which definitions are looked for; deeper ones belong to the chunk around them.
DEPTHS = 8
#: Characters of a chunk that a source reference quotes.
EXCERPT = 500
#: Bytes of text whose lines a task holds and sorts, about; their number of tasks grows with the files.
TASK_BYTES = 2 << 20
#: Kinds of chunks that stand for themselves in relations, and those that name entities.
RELATED_KINDS = ("import", "class", "function", "method", "interface", "type_alias", "artifact")
ENTITY_KINDS = ("class", "function", "method", "interface", "type_alias")

_WORD = r"([A-Za-z_$][\w$]*)"
#: A definition at the beginning of a line: what it is called by, and its name.
_DEFINES = {
    "class": rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:pub\s+)?(?:class|struct|enum)\s+{_WORD}",
    "interface": rf"^\s*(?:export\s+)?(?:pub\s+)?(?:interface|trait)\s+{_WORD}",
    "type_alias": rf"^\s*(?:export\s+)?(?:pub\s+)?type\s+{_WORD}\s*(?:<[^=]*>)?\s*=",
    "function": rf"^\s*(?:export\s+)?(?:default\s+)?(?:pub\s+)?(?:async\s+)?(?:function\s*\*?|def|func|fn)\s+(?:\([^)]*\)\s*)?{_WORD}",
    "constant": rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_WORD}\s*(?::[^=]*)?=\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]*)?=>",
    "method": rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|readonly\s+|get\s+|set\s+)*{_WORD}\s*\([^)]*\)\s*(?::[^{{]*)?\{{\s*(?:\}}|//.*)?$",
}
_IMPORTS = r"""^\s*(?:import\b|from\s+\S+\s+import\b|use\s+\w|export\s+.*\bfrom\s+["'])|\brequire\(\s*["']"""
_NO_METHODS = ("if", "for", "while", "switch", "catch", "function", "return", "with")
#: Strings and comments that end on their line: their braces open nothing.
_QUIET = r"""//.*$|/\*.*?\*/|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`"""


def _lines(files: DataFrame) -> DataFrame:
    """``path, language, line, text, depth, blank``: depth is that before the line, and of a closing brace that after it."""
    own = files.where(F.col("language").isNotNull())
    size = own.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    rows = own.repartition(tasks, "path").select("path", "language", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    rows = rows.withColumn("line", F.col("line") + 1)
    quiet = F.regexp_replace("text", _QUIET, "")
    opened, closed = F.regexp_count(quiet, F.lit(r"\{")), F.regexp_count(quiet, F.lit(r"\}"))
    order = Window.partitionBy("path").orderBy("line")
    before = F.coalesce(F.sum(opened - closed).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leading = F.length(F.regexp_extract("text", r"^([ \t}]*)", 1)) - F.length(F.regexp_replace(F.regexp_extract("text", r"^([ \t}]*)", 1), r"\}", ""))
    indent = F.floor(F.length(F.regexp_replace(F.regexp_extract("text", r"^([ \t]*)", 1), "\t", "    ")) / 4)
    depth = F.when(F.col("language") == "python", indent).otherwise(F.greatest(before - leading, F.lit(0)))
    return rows.select("path", "language", "line", "text", depth.cast("int").alias("depth"), F.col("text").rlike(r"^\s*$").alias("blank"))


def _defined() -> tuple[Column, Column]:
    """The kind and name that a line defines, null if it defines nothing."""
    kind, name = None, None
    for label, pattern in _DEFINES.items():
        found = F.regexp_extract("text", pattern, 1)
        hit = found != ""
        if label == "method":
            hit = hit & ~F.col("language").isin("python", "go", "rust") & ~found.isin(*_NO_METHODS)
        what = F.lit("function" if label == "constant" else label)
        kind = F.when(hit, what) if kind is None else kind.when(hit, what)
        name = F.when(hit, found) if name is None else name.when(hit, found)
    return kind, name


def chunks(files: DataFrame) -> DataFrame:
    """``path, language, kind, name, start_line, end_line, parent_symbol, exported, docstring, content``.

    ``files`` has ``path, language, content``. Each file has a chunk ``module`` of all its lines,
    one without a name from its first to its last import, and one for each definition; a function within a class is a method. The parent is the
    narrowest chunk around it. Of two definitions on one line the first counts.
    """
    kind, name = _defined()
    rows = _lines(files).withColumns({"kind": kind, "name": name})
    rows = rows.withColumn("kind", F.when(F.col("depth") < DEPTHS, F.col("kind")))
    back = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    forth = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.max(F.when(~F.col("blank"), F.col("line"))).over(forth))
    closing = F.struct("line", F.col("text").rlike(r"^\s*\}").alias("brace"), "depth", F.col("_before").alias("before"))
    closes = lambda k: ~F.col("blank") & (F.col("depth") <= k)
    # For each depth the next line that stands no deeper, and the last definition there before a line.
    ends = F.array(*[F.min(F.when(closes(k), closing)).over(back) for k in range(DEPTHS)])
    last = F.max(F.when(~F.col("blank"), F.col("line"))).over(Window.partitionBy("path"))
    rows = rows.withColumns({"_ends": ends, "_last": last})
    following = F.get("_ends", F.col("depth"))
    end = F.when(following.isNull(), F.col("_last")).when(following["brace"] & (following["depth"] == F.col("depth")), following["line"]).otherwise(following["before"])
    rows = rows.withColumn("_end", F.when(F.col("kind").isNotNull(), end))
    here = F.struct(F.col("line").alias("line"), F.col("_end").alias("end"), "kind", "name", "depth")
    held = [F.last(F.when(F.col("kind").isNotNull() & (F.col("depth") == k), here), ignorenulls=True).over(forth) for k in range(DEPTHS)]
    rows = rows.withColumns({"_held": F.array(*held), "_above": F.lag("text").over(Window.partitionBy("path").orderBy("line")), "_below": F.lead("text").over(Window.partitionBy("path").orderBy("line"))})
    found = rows.where("kind IS NOT NULL")
    around = F.filter("_held", lambda h: h.isNotNull() & (h["end"] >= F.col("line")) & (h["depth"] < F.col("depth")))
    parent = F.try_element_at(F.array_sort(around), F.lit(-1))
    found = found.withColumn("_parent", parent)
    in_class = F.col("_parent.kind") == "class"
    doc = F.when(F.col("language") == "python", F.regexp_extract("_below", r'^\s*"""(.*?)(?:""")?\s*$', 1)).otherwise(F.concat(*[F.regexp_extract("_above", r"^\s*(?:/\*\*\s*(.*?)\s*\*/|///?\s*(.*?))\s*$", k) for k in (1, 2)]))
    own = found.select(
        "path", "language", F.when((F.col("kind") == "function") & in_class, "method").otherwise(F.col("kind")).alias("kind"), "name",
        F.col("line").cast("int").alias("start_line"), F.col("_end").cast("int").alias("end_line"), F.col("_parent.name").alias("parent_symbol"),
        (F.col("text").rlike(r"^\s*(?:export|pub)\s") | ((F.col("language") == "python") & (F.col("depth") == 0) & ~F.col("name").startswith("_"))).alias("exported"),
        F.nullif(doc, F.lit("")).alias("docstring"),
    )
    none = F.lit(None).cast("string")
    bounds = rows.where(F.col("text").rlike(_IMPORTS)).groupBy("path", "language").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    own = own.unionByName(
        bounds.select(
            "path", "language", F.lit("import").alias("kind"), none.alias("name"), F.col("start_line").cast("int"), F.col("end_line").cast("int"),
            none.alias("parent_symbol"), F.lit(False).alias("exported"), none.alias("docstring"),
        )
    )
    texts = files.select("path", F.split("content", "\n").alias("_lines"))
    content = F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    own = own.join(texts, "path").withColumn("content", content).drop("_lines")
    module = files.where(F.col("language").isNotNull()).select(
        "path", "language", F.lit("module").alias("kind"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("name"), F.lit(1).alias("start_line"),
        F.size(F.split("content", "\n")).alias("end_line"), none.alias("parent_symbol"), F.lit(False).alias("exported"), none.alias("docstring"), "content",
    )
    return own.unionByName(module)


def _qualified() -> Column:
    symbol = F.coalesce("name", "kind")
    return F.when(F.col("parent_symbol").isNotNull(), F.concat_ws(".", "parent_symbol", symbol)).otherwise(symbol)


def chunk_key() -> Column:
    """What a chunk is known by: its file and qualified symbol."""
    return F.concat(F.col("path"), F.lit("::"), _qualified())


def _identity(kind: Column, title: Column, content: Column, sha256: Column, start: Column, end: Column) -> Column:
    """The SHA-256 of what a record was generated from, so that it is known again."""
    return F.sha2(F.to_json(F.struct(kind.alias("kind"), title.alias("title"), content.alias("content"), F.col("path").alias("path"), sha256.alias("sha256"), start.alias("start"), end.alias("end"))), 256)


def chunk_records(found: DataFrame, files: DataFrame) -> DataFrame:
    """``path, kind, title, content, summary, entity_keys, tags, excerpt, start_line, end_line, identity``.

    A fact for each chunk but the module, and an artifact for each file that has chunks: its
    folder, name, imports and exports. ``files`` has ``path, sha256, imports`` (an array).
    """
    hashes = files.select("path", F.coalesce("sha256", F.lit("")).alias("sha256"), "imports")
    facts = found.where("kind <> 'module'").join(hashes, "path")
    file_key = F.concat(F.lit("file:"), F.col("path"))
    keys = F.array_compact(F.array(F.when(F.col("parent_symbol").isNotNull(), F.concat_ws(".", "parent_symbol", "name")), F.col("name"), file_key))
    start, end = F.col("start_line"), F.col("end_line")
    facts = facts.select(
        "path", F.lit("fact").alias("kind"), chunk_key().alias("title"), "content", F.col("docstring").alias("summary"), keys.alias("entity_keys"),
        F.array("language", "kind", F.lit("indexed")).alias("tags"), F.substring("content", 1, EXCERPT).alias("excerpt"), start, end,
        _identity(F.lit("fact"), chunk_key(), F.col("content"), F.col("sha256"), start, end).alias("identity"),
    )
    exported = F.when(F.col("exported") & F.col("name").isNotNull() & (F.col("kind") != "module"), F.struct("start_line", "name"))
    whole = found.groupBy("path").agg(F.first("language").alias("language"), F.max("end_line").alias("end_line"), F.array_sort(F.collect_list(exported)).alias("_exports")).join(hashes, "path")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    imports = F.when(F.size("imports") > 0, F.concat(F.lit("Imports: "), F.array_join("imports", ", ")))
    exports = F.when(F.size("_exports") > 0, F.concat(F.lit("Exports: "), F.array_join(F.transform("_exports", lambda x: x["name"]), ", "))).otherwise("Summary: indexed module")
    text = F.concat_ws("\n", F.concat(F.lit("Directory: "), folder), F.concat(F.lit("File: "), "path"), imports, exports)
    whole = whole.withColumn("content", text).select(
        "path", F.lit("artifact").alias("kind"), F.col("path").alias("title"), "content", F.lit(None).cast("string").alias("summary"), F.array(file_key).alias("entity_keys"),
        F.array("language", F.lit("module"), F.lit("indexed")).alias("tags"), F.substring("content", 1, EXCERPT).alias("excerpt"), F.lit(1).alias("start_line"), "end_line",
        _identity(F.lit("artifact"), F.col("path"), F.col("content"), F.col("sha256"), F.lit(1), F.col("end_line")).alias("identity"),
    )
    return facts.unionByName(whole)


def entities(found: DataFrame) -> DataFrame:
    """``canonical_name, entity_type, aliases`` of files, modules and named definitions."""
    file = found.select("path").distinct().select(F.concat(F.lit("file:"), "path").alias("canonical_name"), F.lit("file").alias("entity_type"), F.array("path").alias("aliases"))
    module = found.where("kind = 'module' AND name IS NOT NULL").select(chunk_key().alias("canonical_name"), F.lit("module").alias("entity_type"), F.array("name", "path").alias("aliases"))
    own = found.where(F.col("kind").isin(*ENTITY_KINDS) & F.col("name").isNotNull())
    parent = F.when(F.col("parent_symbol").isNotNull(), F.concat_ws(".", "parent_symbol", "name"))
    aliases = F.array_distinct(F.array_compact(F.array("name", F.when(F.col("exported"), F.concat(F.lit("export:"), "name")), parent)))
    kind = F.when(F.col("kind") == "method", "function").otherwise(F.col("kind"))
    return file.unionByName(module).unionByName(own.select(chunk_key().alias("canonical_name"), kind.alias("entity_type"), aliases.alias("aliases")))


def relations(found: DataFrame, imports: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``src, relation, dst`` between titles of records, without those of ``known`` (the same columns).

    A definition and the imports are ``defined_in`` their file, a definition is ``related_to`` its
    parent, the imports are ``derived_from`` the files that they name (``imports`` has ``path,
    target``), and in a test a definition ``supports`` that of its name in the file under test.
    """
    own = found.where(F.col("kind").isin(*RELATED_KINDS)).select("path", "kind", "name", "parent_symbol", chunk_key().alias("src"))
    titles = own.select(F.col("src").alias("dst")).distinct()
    inside = own.select("src", F.lit("defined_in").alias("relation"), F.col("path").alias("dst"))
    parent = own.where("parent_symbol IS NOT NULL").select("src", F.lit("related_to").alias("relation"), F.concat(F.col("path"), F.lit("::"), F.col("parent_symbol")).alias("dst"))
    parent = parent.join(titles, "dst", "left_semi").select("src", "relation", "dst")
    derived = own.where("kind = 'import'").join(imports.select("path", "target"), "path").select("src", F.lit("derived_from").alias("relation"), F.col("target").alias("dst"))
    plain = F.regexp_replace(F.regexp_replace("path", r"\.(test|spec)\.", "."), r"(^|/)test_([^/]*)$", "$1$2")
    tests = own.where(F.col("name").isNotNull() & F.col("path").rlike(r"\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*$"))
    supports = tests.select("src", F.lit("supports").alias("relation"), F.concat(plain, F.lit("::"), "name").alias("dst")).join(titles, "dst", "left_semi").select("src", "relation", "dst")
    out = inside.unionByName(parent).unionByName(derived).unionByName(supports).distinct()
    return out if known is None else out.join(known.select("src", "relation", "dst"), ["src", "relation", "dst"], "left_anti")

"""Source trees as tables: files, kinds, imports, symbols, environment variables, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_newlines

MOST_BYTES = 512 * 1024
SNIFFED = 8 * 1024

#: Languages by extension.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "go": "go", "rs": "rust", "sql": "sql", "md": "markdown", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml",
    "sh": "shell", "html": "html", "css": "css",
}
#: Kinds of files, the first that matches counts.
KINDS = (
    ("manifest", r"(^|/)(package\.json|pyproject\.toml|go\.mod|Cargo\.toml|Makefile)$"),
    ("test", r"(^|/)(tests?|__tests__)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(go|py)$"),
    ("documentation", r"(^|/)docs?/|\.(md|rst|txt)$|(^|/)(README|LICENSE|CHANGELOG)[^/]*$"),
    ("migration", r"(^|/)migrations?/"),
    ("configuration", r"\.(ya?ml|toml|ini|cfg|json|env)$|(^|/)\.[^/]+rc$|(^|/)Dockerfile[^/]*$"),
    ("asset", r"\.(png|jpe?g|gif|svg|ico|woff2?|ttf|pdf|css)$"),
    ("source", r"\.(py|tsx?|jsx?|mjs|go|rs|sql|sh|html)$"),
)
#: Names of files that are never read.
SECRET_FILES = r"(^|/)(\.env(\..*)?|id_rsa|id_ed25519|[^/]*\.(pem|key|p12|pfx))$"


def file_kind(path: Column) -> Column:
    out = None
    for kind, pattern in KINDS:
        out = F.when(path.rlike(pattern), kind) if out is None else out.when(path.rlike(pattern), kind)
    return out.otherwise("other")


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path, kind, language, size_bytes, sha256, content`` of the text files under a folder.

    Secret, binary (a zero byte early on), oversized and not UTF-8 files are left out. The hash
    is taken after line ends are made one.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = raw.sparkSession._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{base.rstrip('/')}/", "")
    files = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"))
    kept = files.where((F.col("size_bytes") <= MOST_BYTES) & ~F.col("path").rlike(SECRET_FILES)).where(
        (F.locate("00", F.regexp_replace(F.hex(F.substring("raw", 1, SNIFFED)), "(..)", "$1 ")) == 0) & F.is_valid_utf8(F.col("raw").cast("string"))
    )
    text = canonical_newlines(F.decode("raw", "UTF-8"))
    return kept.select(
        "path", file_kind(F.col("path")).alias("kind"), language(F.col("path")).alias("language"), "size_bytes",
        F.sha2(text, 256).alias("sha256"), text.alias("content"),
    )


def imports(files: DataFrame) -> DataFrame:
    """``path, specifier`` of the imports in Python, JavaScript, TypeScript, Go and Rust."""
    patterns = {
        "python": r"(?m)^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import|import[ \t]+([\w.]+))",
        "typescript": r"""(?:from|import|require\()\s*["']([^"']+)["']()""",
        "javascript": r"""(?:from|import|require\()\s*["']([^"']+)["']()""",
        "go": r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"()""",
        "rust": r"(?m)^\s*use\s+([\w:]+)()",
    }
    found = None
    for name, pattern in patterns.items():
        both = [F.regexp_extract_all("content", F.lit(pattern), F.lit(k)) for k in (1, 2)]
        hit = F.filter(F.concat(*both), lambda s: s != "")
        found = F.when(F.col("language") == name, hit) if found is None else found.when(F.col("language") == name, hit)
    return files.select("path", F.explode(F.array_distinct(found)).alias("specifier"))


def symbols(files: DataFrame, most: int = 250) -> DataFrame:
    """``path, name, kind, line``: definitions found by pattern, line by line, ``most`` of a file."""
    line = F.posexplode(F.split("content", "\n"))
    rows = files.where(F.col("language").isNotNull()).select("path", line.alias("line", "text"))
    pattern = r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:pub\s+)?(?:async\s+)?(class|def|function|func|fn|interface|struct|enum|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"
    hits = rows.select("path", F.regexp_extract("text", pattern, 2).alias("name"), F.regexp_extract("text", pattern, 1).alias("kind"), (F.col("line") + 1).alias("line")).where("name <> ''")
    return hits.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("k") <= most).drop("k")


def environment_variables(files: DataFrame) -> DataFrame:
    """``name, paths``: the variables that code reads, and where."""
    pattern = r"""(?:process\.env\.|os\.environ(?:\.get)?[\[(]["']|os\.getenv\(["']|os\.Getenv\("|env::var\(")([A-Z][A-Z0-9_]*)"""
    names = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("name"))
    return names.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def package_manifests(files: DataFrame) -> DataFrame:
    """``path, name, ecosystem, dependencies, commands`` of package.json, pyproject.toml, go.mod and Cargo.toml."""
    is_file = lambda n: F.col("path").rlike(rf"(^|/){n}$")
    group = "map<string,string>"
    parsed = F.from_json("content", f"name string, scripts {group}, dependencies {group}, devDependencies {group}, peerDependencies {group}, optionalDependencies {group}")
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    rows = files.withColumn("_j", F.when(is_file(r"package\.json"), parsed))
    four = F.concat(*[keys(F.col(f"_j.{c}")) for c in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")])
    take = lambda p, k=1: F.regexp_extract("content", p, k)
    every = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    cargo = F.regexp_extract_all(F.regexp_extract("content", r"(?s)\[dependencies\](.*?)(?:\n\[|$)", 1), F.lit(r"(?m)^([\w-]+)\s*="), F.lit(1))
    none = F.array().cast("array<string>")
    case = lambda a, b, c, d: F.when(is_file(r"package\.json"), a).when(is_file(r"pyproject\.toml"), b).when(is_file(r"go\.mod"), c).when(is_file(r"Cargo\.toml"), d)
    name = r"""(?m)^name\s*=\s*["']([^"']+)["']"""
    return rows.select(
        "path",
        case(F.col("_j.name"), take(name), take(r"(?m)^module\s+(\S+)"), take(name)).alias("name"),
        case(F.lit("npm"), F.lit("pypi"), F.lit("go"), F.lit("cargo")).alias("ecosystem"),
        F.array_sort(F.array_distinct(case(four, none, every(r"(?m)^\s*(?:require\s+)?([\w.\-/]+\.[\w.\-/]+)\s+v[\w.+-]+"), cargo))).alias("dependencies"),
        case(F.array_sort(keys(F.col("_j.scripts"))), none, none, none).alias("commands"),
    ).where("ecosystem IS NOT NULL")


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """``path, specifier, target``: relative imports joined to the first file that can be meant."""
    suffixes = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js", "/__init__.py")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    joined = F.concat(folder, F.regexp_replace("specifier", r"^\./", ""))
    up = joined
    for _ in range(4):  # a name and the step back from it
        up = F.regexp_replace(up, r"[^/]+/\.\./", "")
    plain = F.regexp_replace(up, r"/\./", "/")
    tries = found.where(F.col("specifier").startswith(".")).select(
        "path", "specifier", F.posexplode(F.array(*[F.concat(plain, F.lit(s)) for s in suffixes])).alias("order", "target")
    )
    hits = tries.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    return hits.groupBy("path", "specifier").agg(F.min_by("target", "order").alias("target"))

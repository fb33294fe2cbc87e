"""Which files of a tree are looked at: ignore rules along the chain of folders, names never read, bounds.

Rules are lines of files named ``.gitignore``. A rule of a deeper folder counts more than one of
a folder above it, a later line more than an earlier one; the last that matches decides, and
what lies in an ignored folder is ignored whatever the rules below say.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Task functions travel with the job, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES = ".gitignore"
#: Bounds of a scan, and names of files that are never read.
MOST_FILES, MOST_BYTES = 100_000, 512 * 1024 * 1024
DENIED = r"(^|/)\.aws(/|$)|(^|/)\.env[^/]*$|(^|/)(\.npmrc|credentials\.json)$|(?i)\.(pem|key)$"


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``*`` and ``?`` stay within a name, ``**`` crosses folders."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
        elif glob[at:] == "**" and (at == 0 or glob[at - 1] == "/"):
            out.append(".*")
            at += 2
        elif c == "*":
            out.append("[^/]*")
            at += len(glob[at:]) - len(glob[at:].lstrip("*"))
        elif c == "?":
            out.append("[^/]")
            at += 1
        elif c == "[" and (end := glob.find("]", at + 2 + (glob[at + 1 : at + 2] in ("!", "^")))) > 0:
            body = glob[at + 1 : end]
            inner = ("^" + body[1:]) if body[0] in "!^" else body
            out.append(f"(?!/)[{inner.replace(chr(92), chr(92) * 2).replace('[', chr(92) + '[').replace('&', chr(92) + '&')}]")
            at = end + 1
        else:
            if c == "\\" and at + 1 < len(glob):
                at += 1
                c = glob[at]
            out.append(re.escape(c))
            at += 1
    return "".join(out)


def compiled(line: str) -> tuple[str, bool, bool] | None:
    """The pattern of a rule for a path below its folder, whether it takes back, and whether it is for folders only."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    if not line:
        return None
    anchored = "/" in line
    pattern = glob_pattern(line.removeprefix("/"))
    return (f"^{pattern}$" if anchored else f"^(?:.*/)?{pattern}$"), negated, folders


def _compile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(f, p, *c) for f, p, x in zip(*(batch.column(n).to_pylist() for n in ("folder", "place", "line")), strict=True) if (c := compiled(x))]
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["folder", "place", "pattern", "negated", "folders"])


def ignore_rules(files: DataFrame) -> DataFrame:
    """``folder, place, pattern, negated, folders`` of the rules in the ignore files among ``path, content``."""
    own = files.where(F.col("path").rlike(rf"(^|/)\{RULES}$"))
    lines = own.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.posexplode(F.split("content", "\n")).alias("place", "line"))
    return lines.mapInArrow(_compile, "folder string, place int, pattern string, negated boolean, folders boolean")


def _above(path: Column) -> Column:
    """The folders above a path, from the root (an empty name) down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``path`` of the files that the rules leave out.

    A rule meets only what lies below its folder: joined on folder names, not on all rules.
    Each folder is judged once, however many files it has.
    """
    tree = paths.select("path", F.explode(F.concat(F.filter(_above(F.col("path")), lambda f: f != ""), F.array("path"))).alias("entry"))
    entries = tree.select("entry", (F.col("entry") != F.col("path")).alias("is_folder")).distinct()
    below = entries.select("entry", "is_folder", F.explode(_above(F.col("entry"))).alias("folder"))
    name = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.substr("entry", F.length("folder") + 2))
    met = below.join(rules, "folder").where((F.col("is_folder") | ~F.col("folders")) & F.regexp_like(name, F.col("pattern")))
    depth = F.size(F.split("folder", "/")) - (F.col("folder") == "").cast("int")
    verdict = met.groupBy("entry", "is_folder").agg(F.max_by("negated", F.struct(depth, "place")).alias("kept"))
    gone = verdict.where("NOT kept").select("entry", "is_folder")
    return tree.withColumn("is_folder", F.col("entry") != F.col("path")).join(gone, ["entry", "is_folder"]).select("path").distinct()


def discovered(files: DataFrame, include: Sequence[str] = ("**/*",), exclude: Sequence[str] = (), most_bytes: int = 512 * 1024) -> DataFrame:
    """``files`` (``path, size_bytes, content``) that may be read: included, not excluded, ignored, denied or too large."""
    among = lambda globs: F.col("path").rlike("|".join(f"^(?:{glob_pattern(g)})$" for g in globs))
    wanted = files.where(among(include) & ~F.col("path").rlike(DENIED) & (F.col("size_bytes") <= most_bytes))
    if exclude:
        wanted = wanted.where(~among(exclude))
    return wanted.join(ignored(wanted.select("path"), ignore_rules(files)), "path", "left_anti")


def bounded(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``files`` in order of path as far as the bounds go, with ``complete``: whether that is all of them.

    The bounds are the feature: what is beyond them isn't looked at, and nothing may be
    concluded from its absence.
    """
    first = files.orderBy("path").limit(most_files + 1)
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    summed = first.select("*", F.row_number().over(Window.orderBy("path")).alias("_n"), F.sum("size_bytes").over(order).alias("_bytes"))
    fits = (F.col("_n") <= most_files) & (F.col("_bytes") <= most_bytes)
    whole = F.min(fits).over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return summed.withColumn("complete", whole).where(fits).drop("_n", "_bytes")

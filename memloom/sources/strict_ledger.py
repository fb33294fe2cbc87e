"""Ledgers read strictly: numbered lines, the first rule that each breaks, and proof of what was read.

A line is canonical JSON after RFC 8785 (keys by UTF-16 units, numbers as ECMAScript writes
them) of one event without unknown fields. A ledger's attestation is its lines, bytes and a
digest folded over its lines in order, block by block, so that ledgers of any size are hashed
side by side and a longer ledger can be shown to begin with the bytes of a shorter one.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CREDENTIALS
from ..operators.ledger import numbered, saved, small

# Task functions travel with the job, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bounds and names that events must keep to.
MOST_BYTES = 64 * 1024 * 1024
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:-]{2,127}$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
KINDS = ("fact", "decision", "workflow", "mistake", "preference", "handoff", "invariant")
SUBJECTS = ("repo", "file", "symbol", "command", "test", "api", "architecture", "task")
STATES = ("active", "superseded", "retracted")
AUTHORITIES = ("human", "agent", "tool", "system")
SENSITIVITIES = ("public", "internal", "confidential", "restricted")
METHODS = ("explicit", "observed", "imported")
#: Lines whose hashes are hashed together.
FOLD = 1024


# Canonical JSON


class NotCanonical(ValueError):
    """A value that RFC 8785 can't write: a number that no double holds, or half of a surrogate pair."""


_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_ESCAPED = re.compile('["\\\\\x00-\x1f]')
_ENCODED = json.JSONEncoder(separators=(",", ":"), sort_keys=True).encode
_HALF = re.compile("[\ud800-\udfff]")


def _text(value: str) -> str:
    if _HALF.search(value):
        raise NotCanonical
    return '"' + _ESCAPED.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", value) + '"'


def _number(value: float) -> str:
    """The shortest digits that read back as ``value``, in the form that ECMAScript gives them."""
    if isinstance(value, int):
        if abs(value) >= 1 << 53:
            raise NotCanonical
        return str(value)
    if not math.isfinite(value):
        raise NotCanonical
    if value == 0:
        return "0"
    mantissa, _, exponent = f"{abs(value)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole.lstrip("0")) if whole.strip("0") else len(digits) - len(part)
    point += int(exponent or 0)
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{digits}"
    else:
        sign = "+" if point > 0 else "-"
        out = f"{digits[0]}{'.' if n > 1 else ''}{digits[1:]}e{sign}{abs(point - 1)}"
    return f"-{out}" if value < 0 else out


def canonical(value: object) -> str:
    """``value`` as RFC 8785 writes it."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    # A key with half of a pair can be ordered, and fails when it is written.
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{_text(k)}:{canonical(value[k])}" for k in keys) + "}"


# Rules of an event

Check = Callable[[object], str | None]


def _of(kind: type, *tests: Callable[[object], bool]) -> Check:
    """A value of a type that passes all tests; the answer is where it fails below the value, or None."""
    return lambda v: None if type(v) is kind and all(t(v) for t in tests) else ""


def _optional(check: Check) -> Check:
    return lambda v: None if v is None else check(v)


def _among(names: tuple[str, ...]) -> Check:
    return _of(str, lambda v: v in names)


def _long(least: int, most: int) -> Callable[[str], bool]:
    return lambda v: least <= len(v) <= most


def _share(v: object) -> str | None:
    return None if type(v) in (int, float) and 0 <= v <= 1 else ""


def _positive(v: object) -> str | None:
    return None if type(v) is int and v >= 1 else ""


def _list(check: Check, most: int = 256) -> Check:
    def run(values: object) -> str | None:
        if type(values) is not list or len(values) > most:
            return ""
        for k, v in enumerate(values):
            at = check(v)
            if at is not None:
                return f".{k}{at}"
        return None

    return run


def _record(fields: dict[str, tuple[Check, bool]], whole: Callable[[dict], bool]) -> Check:
    """An object with these fields, in this order: checks and whether a field may be missing. Then no others, then the rule on the whole."""

    def run(value: object) -> str | None:
        if type(value) is not dict:
            return ""
        for name, (check, may_miss) in fields.items():
            at = check(value[name]) if name in value else (None if may_miss else "")
            if at is not None:
                return f".{name}{at}"
        more = [k for k in value if k not in fields]
        if more:
            return f".{more[0]}"
        return None if whole(value) else ""

    return run


def _blank_run(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _collapsed(value: str | None) -> bool:
    return value is None or (bool(value) and value == _blank_run(value))


def _inside(path: str, root: bool = False) -> bool:
    """Whether a path is relative, normalised and inside the repository; ``.`` is only where ``root`` says so."""
    if root and path == ".":
        return True
    plain = "\\" not in path and not path.startswith("/") and path[1:2] != ":"
    return plain and not any(p in ("", ".", "..") for p in path.split("/"))


def _units(text: str) -> bytes:
    return text.encode("utf-16-be", "surrogatepass")


def _source_rule(s: dict) -> bool:
    first, last = s.get("start_line"), s.get("end_line")
    return _inside(s["path"]) and all(_collapsed(s.get(c)) for c in ("symbol", "blob", "commit")) and not (first and last and last < first)


def _provenance_rule(p: dict) -> bool:
    return p["actor"] == p["actor"].strip() and all(_collapsed(p.get(c)) for c in ("agent", "session_id", "command"))


def _values(value: object) -> Iterator[object]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from _values(v)
    elif isinstance(value, list):
        for v in value:
            yield from _values(v)
    else:
        yield value


#: What any match of each pattern of ``CREDENTIALS`` holds in lower case, so that few lines are searched by it.
_MARKS = (
    ("private key-----",), ("sk-",), ("sk_",), ("gh",), ("github_pat_",), ("xox",), ("akia", "asia"), ("glpat-",), ("sk_live_",), ("aiza",), ("eyj",), ("://",),
    ("password", "passwd", "token", "secret", "api"),
)
_SECRETS = [(marks, re.compile(p, re.IGNORECASE)) for marks, p in zip(_MARKS, CREDENTIALS, strict=True)]


def _secret(text: str) -> bool:
    """Whether a text of ASCII characters holds a credential."""
    lower = text.lower()
    return any(any(m in lower for m in marks) and p.search(text) is not None for marks, p in _SECRETS)


#: In the JSON of a value, what may be half a surrogate pair or a number that no double holds.
_DOUBTFUL = re.compile(r"\\ud|[0-9]{16}|NaN|Infinity")
#: Numbers that Python may write otherwise than ECMAScript, and escapes of what is written as it is.
_WRITTEN_OTHERWISE = re.compile(r"\\u|\.0(?![0-9])|[0-9][eE]|[0-9]{16}|NaN|Infinity")


def _shallow(text: str) -> bool:
    return text.count("{") + text.count("[") < 200


def _is_canonical(value: object, line: str) -> bool:
    """Whether ``canonical`` gives the line; ASCII without doubtful numbers is written alike by ``json``."""
    if line.isascii() and _shallow(line) and not _WRITTEN_OTHERWISE.search(line) and _ENCODED(value) == line:
        return True
    return canonical(value) == line


def _portable(value: object, text: str) -> bool:
    """Whether strings are whole and numbers fit a double; ``text`` is the value's JSON in ASCII."""
    if _shallow(text) and not _DOUBTFUL.search(text):
        return True
    for v in _values(value):
        if isinstance(v, str) and _HALF.search(v):
            return False
        if type(v) is int and abs(v) >= 1 << 53 or type(v) is float and not math.isfinite(v):
            return False
    return True


def _event_rule(e: dict) -> bool:
    lists = {c: e.get(c, []) for c in ("applies_to", "supersedes", "tags", "triggers")}
    try:
        made, changed = (datetime.fromisoformat(e[c]) for c in ("created_at", "updated_at"))
    except ValueError:
        return False
    decides = e["kind"] in ("decision", "preference")
    place = lambda s: (_units(s["path"]), s.get("start_line") or 0, _units(s.get("symbol") or ""))
    sources = e.get("sources", [])
    text = _ENCODED(e)
    return (
        _portable(e, text)
        and not _secret(text)
        and changed >= made
        and e["id"] not in lists["supersedes"]
        and e["sensitivity"] in ("public", "internal")
        and e["title"] == e["title"].strip()
        and e["body"] == e["body"].strip()
        and len(json.dumps(e.get("structured_data", {}), ensure_ascii=False, separators=(",", ":"))) <= 100_000
        and all(v and v == _blank_run(v) for values in lists.values() for v in values)
        and all(values == sorted(set(values), key=_units) for values in lists.values())
        and all(_inside(p, root=True) for p in lists["applies_to"])
        and sources == sorted(sources, key=place)
        and (e["provenance"]["method"] == "explicit" or not (decides or "rationale" in e.get("structured_data", {})))
        and (e["authority"] in ("human", "agent") or not decides)
    )


_SOME, _TEXT = _optional(_of(str, _long(0, 50_000))), _of(str)
_matching = lambda pattern: _of(str, lambda v: re.search(pattern, v) is not None and not v.endswith("\n"))
_SOURCE = _record(
    {"path": (_of(str, _long(1, 4096)), False), "symbol": (_SOME, True), "start_line": (_optional(_positive), True),
     "end_line": (_optional(_positive), True), "blob": (_SOME, True), "commit": (_SOME, True)}, _source_rule,
)
_PROVENANCE = _record(
    {"actor": (_of(str, _long(1, 512)), False), "method": (_among(METHODS), False), "agent": (_SOME, True),
     "session_id": (_SOME, True), "command": (_optional(_of(str, _long(0, 8192))), True)}, _provenance_rule,
)
_EVENT = _record(
    {
        "schema_version": (_of(int, lambda v: v == 1), False), "id": (_matching(IDENTIFIER), False), "kind": (_among(KINDS), False),
        "subject_type": (_among(SUBJECTS), False), "title": (_of(str, _long(1, 512)), False), "body": (_of(str, _long(1, 50_000)), False),
        "structured_data": (_of(dict), True), "status": (_among(STATES), False), "applies_to": (_list(_TEXT), True),
        "sources": (_list(_SOURCE), True), "provenance": (_PROVENANCE, False), "authority": (_among(AUTHORITIES), False),
        "confidence": (_share, False), "importance": (_share, False), "sensitivity": (_among(SENSITIVITIES), False),
        "created_at": (_matching(TIMESTAMP), False), "updated_at": (_matching(TIMESTAMP), False),
        "supersedes": (_list(_TEXT), True), "tags": (_list(_TEXT), True), "triggers": (_list(_TEXT), True),
    },
    _event_rule,
)


class _Twice(ValueError):
    pass


def _once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise _Twice
    return found


def broken_rule(line: str) -> tuple[str | None, str | None]:
    """The event's id, and the first rule that a line breaks by itself; null if it breaks none."""
    try:
        record = json.loads(line, object_pairs_hook=_once)
    except _Twice:
        return None, "duplicate keys"
    except (ValueError, RecursionError):
        return None, "invalid json"
    if type(record) is not dict:
        return None, "not an object"
    try:
        at = _EVENT(record)
    except RecursionError:
        return None, "too deep"
    if at is not None:
        return None, f"invalid {at.lstrip('.') or 'event'}"
    try:
        return record["id"], None if _is_canonical(record, line) else "not canonical"
    except NotCanonical:
        return record["id"], "cannot be canonical"


# Lines


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ledger, line_number, line`` of text files, without blank lines; numbers count them, from 1.

    Two passes over the files and no shuffle of lines: the first counts the lines of each block
    of a file, the second numbers on from what stands before its block. A carriage return before
    the end of a line isn't part of it.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("ledger"), F.col("_metadata.file_block_start").alias("block"))
    blocks = raw.groupBy("ledger", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("ledger").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("ledger", "block", before.alias("first"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        n = 0
        for batch in batches:
            numbers = []
            for key in zip(batch.column("ledger").to_pylist(), batch.column("block").to_pylist(), strict=True):
                n = n + 1 if key == at else 1
                at = key
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "n"])

    lines = raw.mapInArrow(count, "value string, ledger string, block long, n long").join(F.broadcast(starts), ["ledger", "block"])
    line = F.regexp_replace("value", "\r$", "")
    return lines.select("ledger", (F.col("first") + F.col("n")).alias("line_number"), line.alias("line")).where(~is_blank(F.col("line")))


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^\s\x1c-\x1f\x85\xa0]")


def checked(lines: DataFrame) -> DataFrame:
    """``ledger, line_number, line, id, rule``: the first rule that each line breaks, null for a good one.

    ``lines`` has ``ledger, line_number, line``; blank lines are left out. Of the lines of one id
    that break no other rule but their form, all but the first are "duplicate id". Other lines
    don't make a later one a duplicate, since they never become events.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [broken_rule(x) for x in batch.column("line").to_pylist()]
            more = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["ledger", "line_number", "line", "id", "rule"])

    plain = lines.select(F.col("ledger").cast("string"), F.col("line_number").cast("long"), "line").where(~is_blank(F.col("line")))
    judged = plain.mapInArrow(judge, "ledger string, line_number long, line string, id string, rule string")
    # Lines without an event stay apart, however many they are.
    alone = F.when(F.col("id").isNull(), F.col("line_number"))
    first = F.min("line_number").over(Window.partitionBy("ledger", "id", alone))
    again = F.col("id").isNotNull() & (F.col("line_number") > first)
    return judged.withColumn("rule", F.when(again, "duplicate id").otherwise(F.col("rule")))


def attestation(lines: DataFrame, upto: DataFrame | None = None) -> DataFrame:
    """Per ledger ``n_lines, size_bytes, digest``; with ``upto`` (``ledger, n_lines``) of its first lines only.

    ``size_bytes`` counts a newline after each line. Lines are hashed by SHA-256, then the
    hashes of ``FOLD`` lines in order together, then those, until one is left. No task holds
    more than ``FOLD`` hashes of a ledger.
    """
    lined = lines.select("ledger", F.col("line_number").cast("long").alias("at"), "line")
    if upto is not None:
        bound = small(upto.select(F.col("ledger").alias("_l"), F.col("n_lines").alias("_n")))
        lined = lined.join(bound, (F.col("ledger") == F.col("_l")) & (F.col("at") <= F.col("_n"))).drop("_l", "_n")
    level = lined.select(
        "ledger", "at", F.lit(1).cast("long").alias("n_lines"), (F.octet_length("line") + 1).cast("long").alias("size_bytes"), F.sha2("line", 256).alias("digest")
    )
    most = lined.agg(F.max("at")).first()[0] or 1
    while True:
        # Lines are numbered from 1, the blocks of a level from 1 again.
        level = level.groupBy("ledger", F.floor((F.col("at") - 1) / FOLD).alias("block")).agg(
            F.sum("n_lines").alias("n_lines"),
            F.sum("size_bytes").alias("size_bytes"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"),
        )
        level = level.select("ledger", (F.col("block") + 1).alias("at"), "n_lines", "size_bytes", "digest")
        most = -(-most // FOLD)
        if most <= 1:
            return level.drop("at")


def extension(old: DataFrame, new: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per ledger of ``old`` attestations whether the lines of ``new`` may follow it: ``ledger, verdict``.

    "same", "extended", "shorter", "changed" where its first lines aren't the attested ones,
    "too large" beyond the bound, "missing" without any line.
    """
    now = attestation(new).select("ledger", F.col("n_lines").alias("_n"), F.col("size_bytes").alias("_bytes"))
    prefix = attestation(new, old).select("ledger", F.col("digest").alias("_digest"))
    both = old.join(now, "ledger", "left").join(prefix, "ledger", "left")
    verdict = (
        F.when(F.col("_n").isNull(), "missing")
        .when(F.col("_bytes") > most_bytes, "too large")
        .when(F.col("_n") < F.col("n_lines"), "shorter")
        .when(~F.col("digest").eqNullSafe(F.col("_digest")), "changed")
        .when(F.col("_n") == F.col("n_lines"), "same")
        .otherwise("extended")
    )
    return both.select("ledger", verdict.alias("verdict"))


def disagreements(events: DataFrame, lines: DataFrame) -> DataFrame:
    """``ledger, line_number, problem``: where a table of events isn't what the lines say, in order.

    ``events`` has ``ledger, line_number, event``, the canonical text of each event; ``lines``
    is numbered without gaps.
    """
    said = events.select("ledger", "line_number", F.col("event").alias("_said"))
    both = lines.select("ledger", "line_number", "line").join(said, ["ledger", "line_number"], "full_outer")
    problem = F.when(F.col("line").isNull(), "no such line").when(F.col("_said").isNull(), "no event").when(F.col("line") != F.col("_said"), "differs")
    return both.select("ledger", "line_number", problem.alias("problem")).where("problem IS NOT NULL")


def appended(lines: DataFrame, more: DataFrame, attested: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The ledger lines after an append, and what was refused: ``ledger, line, rule``.

    ``more`` has ``ledger, place, line``. Nothing is added to a ledger that isn't the attested
    one any more, nor lines that break a rule or repeat an id, nor what passes the bound; the
    lines that are left follow in the order of ``place``.
    """
    state = attestation(lines)
    known = small(saved(extension(attested, lines, most_bytes).select("ledger", F.col("verdict").alias("_verdict"))))
    size = small(saved(state.select("ledger", F.col("n_lines").alias("_n"), F.col("size_bytes").alias("_bytes"))))
    both = lines.select("ledger", "line_number", "line").unionByName(
        more.join(size.select("ledger", "_n"), "ledger", "left").select("ledger", (F.coalesce("_n", F.lit(0)) + F.col("place")).alias("line_number"), "line")
    )
    new = checked(both).join(size, "ledger", "left").where(F.col("line_number") > F.coalesce("_n", F.lit(0)))
    new = new.join(known, "ledger", "left")
    stale = F.coalesce("_verdict", F.lit("same")) != "same"
    new = saved(new.withColumn("rule", F.when(stale, "ledger changed").otherwise(F.col("rule"))))
    # What passes the bound is the end of a ledger's good lines, so their places are also those of the lines kept.
    placed = numbered(new.where("rule IS NULL"), ["ledger"], ["line_number"], "place", F.octet_length("line") + 1)
    fits = F.coalesce("_bytes", F.lit(0)) + F.col("place_total") <= most_bytes
    good = placed.where(fits).select("ledger", (F.coalesce("_n", F.lit(0)) + F.col("place")).cast("long").alias("line_number"), "line")
    refused = new.where("rule IS NOT NULL").select("ledger", "line", "rule").unionByName(placed.where(~fits).select("ledger", "line", F.lit("too large").alias("rule")))
    return lines.select("ledger", F.col("line_number").cast("long"), "line").unionByName(good), refused

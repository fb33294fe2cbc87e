"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines are compared trimmed and lower-cased. Of ``threshold + 1`` segments of a line one, the i-th,
has no edit, at most i edits to its left and at most ``threshold - i`` to its right: with e edits so
far, take the last i with e >= i. So a segment of the left half is found within i characters of its
place from the start, and one of the right half within ``threshold - i`` of its place from the end,
however much longer the other line is. Lengths form classes, whose lines have segments of one size;
segments are indexed by class and number, and each line probes its class, and the one below if a line
of it can be near enough, with the few substrings that can match. Lines that meet, and whose lengths
are near enough, are verified by Spark's banded ``levenshtein``, long ones by banded bit-parallel steps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lookup, saved
from .components import bucket_links, components

#: Lines of fewer code points (trimmed) are left as they are, unless exact repeats are asked for.
MIN_CHARS = 20
THRESHOLD = 3
NULL_ID = -(2**63)


def _class_start(n: Column, threshold: int) -> Column:
    """The least length of the class that length ``n`` is in.

    A class is as wide as the third highest bit of its lengths, so the longest of its lines are longer than the shortest
    by a quarter at most; it is wider than ``threshold``, so that lines that can be linked are in one class or in neighbouring ones.
    """
    bits = F.greatest(F.length(F.bin(n)) - 3, F.lit(threshold.bit_length()))
    return F.call_function("shiftleft", F.call_function("shiftright", n, bits), bits)


def signatures(threshold: int, start: Column) -> tuple[list[Column], list[Column]]:
    """Hashes of the segments, and of the probing substrings, of ``line`` of ``chars`` characters for the class of ``start``.

    All lines of a class have segments of one size. Those of the left half are counted from the line's start, the others
    from its end, so that no length need be probed for itself. A segment's hash holds the class, its number and its characters.
    """
    parts, n = threshold + 1, F.col("chars")
    size = F.floor(start / parts).cast("int")
    own: list[Column] = []
    probes: list[Column] = []
    for i in range(parts):
        left = i < parts - i
        most = i if left else threshold - i
        at = size * i + 1 if left else n - size * (parts - i) + 1
        for shift in range(-most, most + 1):
            key = F.xxhash64(start, F.lit(i), F.substring(F.col("line"), at + shift, size))
            if shift:
                probes.append(F.when((at + shift >= 1) & (at + shift + size - 1 <= n), key))
            else:
                own.append(key)
    return own, probes


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two texts are at most ``threshold`` edits apart, by banded bit-parallel steps.

    For each number of edits e a word of 2 * threshold + 1 bits tells on which diagonals of the
    band the prefixes read so far are within e edits. A character of ``b`` updates all
    diagonals of a word at once.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    start = F.array(*[F.lit(sum(1 << d for d in range(threshold, threshold + e + 1)) & full) for e in range(threshold + 1)])

    def verified(t: Column) -> Column:
        n, m = t["n"], t["m"]

        def step(state: Column, j: Column) -> Column:
            c = F.get(t["y"], j - 1)
            hit = F.lit(0)
            for d in range(width):
                i = j + (d - threshold)  # from 1
                same = F.when((i >= 1) & (i <= n), F.get(t["x"], i - 1) == c)
                hit = hit.bitwiseOR(F.when(same, 1 << d).otherwise(0))

            def moved(hit: Column) -> Column:
                now: list[Column] = []
                for e in range(threshold + 1):
                    new = F.get(state, F.lit(e)).bitwiseAND(hit)
                    if e:
                        less = F.get(state, F.lit(e - 1))
                        new = new.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(now[-1], 1))
                    now.append(new.bitwiseAND(F.lit(full)))
                return F.array(*now)

            return _let(hit, moved)

        end = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), m), start, step)).otherwise(start)
        bit = F.call_function("shiftright", F.element_at(end, -1), n - m + threshold)
        return F.when(F.abs(n - m) <= threshold, bit.bitwiseAND(F.lit(1)) == 1).otherwise(False)

    chars = lambda text: F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    texts = F.struct(chars(a).alias("x"), chars(b).alias("y"), F.length(a).alias("n"), F.length(b).alias("m"))
    return _let(texts, verified)


def _common(x: Column, y: Column, n: Column, m: Column, most: Column, last: bool) -> Column:
    """How many characters two texts of ``n`` and ``m`` have in common at one end, up to ``most``.

    Found by halving steps: each step compares the next piece, as long as a power of two.
    """

    def step(so_far: Column, power: Column) -> Column:
        k = F.call_function("shiftleft", F.lit(1), power)
        end = lambda text, size: F.substring(text, size - so_far - k + 1 if last else so_far + 1, k)
        return F.when((so_far + k <= most) & (end(x, n) == end(y, m)), so_far + k).otherwise(so_far)

    return F.aggregate(F.sequence(F.ceil(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1)), F.lit(0), step)


#: Shorter cores are verified without a look at their halves.
SHORT_CORE = 12


def _half_alike(c: Column) -> Column:
    """Whether half of two cores, without their outer characters, is equal at nearly the same place.

    Cores begin and end with an edit, so of three edits at most one is between: one half has none.
    """
    x, y, n, m = c["x"], c["y"], c["n"], c["m"]
    mid = F.shiftright(n, 1)
    left, right = F.substring(x, F.lit(2), mid - 1), F.substring(x, mid + 1, n - 1 - mid)
    tests = []
    for d in (-1, 0, 1):
        tests.append(left == F.substring(y, F.lit(2 + d), mid - 1))
        tests.append(right == F.substring(y, mid + 1 + (m - n) + d, n - 1 - mid))
    return (F.least(n, m) < SHORT_CORE) | reduce(lambda a, b: a | b, tests)


#: Longer lines are verified by :func:`_near_long`: the time that ``levenshtein`` takes grows with the square of the length.
SHORT_LINE = 512


def near(x: Column, y: Column, threshold: int) -> Column:
    """Whether two lines are at most ``threshold`` edits apart."""
    short = F.greatest(F.length(x), F.length(y)) <= SHORT_LINE
    return F.when(short, F.levenshtein(x, y, threshold) >= 0).otherwise(_near_long(x, y, threshold))


def _near_long(x: Column, y: Column, threshold: int) -> Column:
    """As :func:`near`, for lines of any length.

    Common ends are taken off first, which leaves the distance as it is.
    """

    def cored(c: Column) -> Column:
        if threshold == 1:
            return F.greatest(c["n"], c["m"]) <= 1
        full = within(c["x"], c["y"], threshold)
        if threshold <= 3:
            full = F.when(_half_alike(c), full).otherwise(False)
        return F.when(F.least(c["n"], c["m"]) <= 0, True).otherwise(full)

    def sized(t: Column) -> Column:
        n, m = t["n"], t["m"]
        most = F.least(n, m)

        def cut(p: Column) -> Column:
            core = lambda text, size, s: F.substring(text, p + 1, size - p - s)
            rest = lambda s: F.struct(
                core(x, n, s).alias("x"), core(y, m, s).alias("y"), (n - p - s).alias("n"), (m - p - s).alias("m")
            )
            return _let(_common(x, y, n, m, most - p, last=True), lambda s: _let(rest(s), cored))

        return F.when(F.abs(n - m) <= threshold, _let(_common(x, y, n, m, most, last=False), cut)).otherwise(False)

    return _let(F.struct(F.length(x).alias("n"), F.length(y).alias("m")), sized)


def _keyed(docs: DataFrame) -> DataFrame:
    """``id, version, text``: texts without nulls, named by id and hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return docs.select(key.alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _lines(texts: DataFrame) -> DataFrame:
    """``id, version, n, line, chars``: each line of each text, trimmed and lower-cased, by its number.

    A text is lower-cased as a whole: no letter's lower case depends on what stands beyond a line's end.
    """
    raw = texts.select("id", "version", F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("n", "line"))
    return raw.withColumn("line", F.trim("line")).withColumn("chars", F.length("line"))


def split_lines(docs: DataFrame) -> DataFrame:
    """The lines of ``docs``, as ``id, version, n, line, chars``."""
    return _lines(_keyed(docs))


def _met(distinct: DataFrame, threshold: int) -> DataFrame:
    """``bucket, node``: lines that share a segment, or probe one, with another line of nearly the same length."""
    classed = distinct.select("node", "line", "chars", _class_start(F.col("chars"), threshold).alias("start")).withColumn(
        "below", _class_start(F.greatest(F.col("chars") - threshold, F.lit(0)), threshold)
    )
    own, probes = signatures(threshold, F.col("start"))
    lower = F.when(F.col("below") < F.col("start"), F.array(*[k for keys in signatures(threshold, F.col("below")) for k in keys]))

    def each(keys: Column) -> DataFrame:
        # keys are computed before they are exploded, and by an outer explode, so that they are computed once
        rows = classed.select("node", "chars", keys.alias("keys")).select(F.explode_outer("keys").alias("bucket"), "node", "chars")
        return rows.where("bucket IS NOT NULL")

    index = each(F.array(*own))
    indexed = saved(index.groupBy("bucket").agg(F.count("*").alias("n")))
    probing = each(F.concat(F.array(*probes), F.coalesce(lower, F.array().cast("array<bigint>"))))
    hits = checkpoint(probing.join(indexed.select("bucket"), "bucket", "left_semi"))
    wanted = checkpoint(hits.select("bucket").union(indexed.where("n > 1").select("bucket")).distinct())
    met = hits.union(index.join(lookup(wanted), "bucket", "left_semi"))
    # a line is in two windows of lengths, so that lengths up to the threshold apart share one
    window = F.posexplode(F.array(F.expr(f"chars DIV {threshold + 1}"), F.expr(f"chars DIV {threshold + 1} + 1"))).alias("second", "w")
    windows = checkpoint(met.select("bucket", "node", window).select(F.xxhash64("bucket", "w").alias("bucket"), "node", "second").distinct())
    # lines that are all in their second window have met in their first
    useful = windows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("second").alias("least")).where("n > 1 AND least = 0")
    return checkpoint(windows.join(useful.select("bucket"), "bucket", "left_semi").select("bucket", "node"))


#: Lines in a block of a bucket; two blocks are compared in one group of a join.
BLOCK_LINES = 1024
#: Characters that are counted. An edit changes two counts by one at most.
COUNTED = "etaoinsrhldu "


def _counts(line: Column) -> Column:
    return F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED])


def _countable(x: Column, y: Column, threshold: int) -> Column:
    """Whether lines of these counts can be so few edits apart; a cheap test before the lines are compared."""
    return reduce(lambda a, b: a + b, [F.abs(F.get(x, i) - F.get(y, i)) for i in range(len(COUNTED))]) <= 2 * threshold


def _tests(known: DataFrame, threshold: int) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """How pairs are confirmed, and how links are found among the nodes of a bucket.

    ``known`` has ``node, line, chars, counts`` of all lines that met another.
    """

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(known.select(F.col("node").alias("b"), F.col("line").alias("y")), "b").join(
            known.select(F.col("node").alias("a"), F.col("line").alias("x")), "a"
        )
        return both.where(near(F.col("x"), F.col("y"), threshold)).select("a", "b")

    def among(left: DataFrame) -> DataFrame:
        """A bucket is dealt to blocks by a hash, and blocks are joined in pairs. Short lines are compared there, long ones after."""
        blocks = left.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_LINES).cast("int").alias("k"))
        short = F.when(F.col("chars") <= SHORT_LINE, F.col("line")).alias("line")
        counted = left.join(known.select("node", "chars", "counts", short), "node").join(blocks, "bucket")
        dealt = saved(counted.withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")))

        def side(name: str, own: str, other: str, others: Column) -> DataFrame:
            of = [F.col(c).alias(f"{c}_{name}") for c in ("node", "component", "chars", "counts", "line")]
            return dealt.select("bucket", F.col("block").alias(own), F.explode(others).alias(other), *of)

        x = side("x", "i", "j", F.sequence("block", F.col("k") - 1))
        y = side("y", "j", "i", F.sequence(F.lit(0), "block"))
        able = (
            ((F.col("i") < F.col("j")) | (F.col("node_x") < F.col("node_y")))
            & (F.col("component_x") != F.col("component_y"))
            & (F.abs(F.col("chars_x") - F.col("chars_y")) <= threshold)
            & _countable(F.col("counts_x"), F.col("counts_y"), threshold)
            & F.coalesce(F.levenshtein("line_x", "line_y", threshold) >= 0, F.lit(True))
        )
        pairs = x.join(y, ["bucket", "i", "j"]).where(able)
        return confirm(checkpoint(pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()))

    return confirm, among


def duplicate_lines(
    docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None
) -> DataFrame:
    """``id, version, n``: the lines to remove; see :func:`dedupe_lines`."""
    name = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2")]
    least = min_chars if exact_chars is None else min(exact_chars, min_chars)
    long_lines = split_lines(docs).where(F.col("chars") >= least)
    distinct = saved(
        long_lines.groupBy("line")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        .select("line", F.length("line").alias("chars"), *name, "id", "copies", F.monotonically_increasing_id().alias("node"))
    )
    met = _met(distinct.where(F.col("chars") >= min_chars), threshold)
    nodes = lookup(checkpoint(met.select("node").distinct()))
    known = saved(
        distinct.select("node", "line", "chars").join(nodes, "node", "left_semi").withColumn("counts", _counts(F.col("line")))
    )
    linked = checkpoint(components(bucket_links(met, *_tests(known, threshold))).withColumnRenamed("id", "node"))
    first = distinct.select("node", "id").join(lookup(linked), "node").groupBy("component").agg(F.min("id").alias("first_id"))
    again = (
        distinct.select("node", "h1", "h2", "id", "copies")
        .join(lookup(checkpoint(linked.join(first, "component"))), "node", "left")
        .where("component IS NOT NULL OR copies > 1")
        .select("h1", "h2", F.coalesce("component", "node").alias("component"), F.coalesce("first_id", "id").alias("first_id"))
    )
    named = long_lines.select("id", "version", "n", *name)
    found = checkpoint(named.join(again, ["h1", "h2"]).drop("h1", "h2"))
    kept = (
        found.where("id = first_id")
        .groupBy("component", "id")
        .agg(F.min(F.struct("version", "n")).alias("at"))
        .select("component", F.col("at.version").alias("version"), F.col("at.n").alias("n"), "id")
    )
    return found.join(kept, ["component", "id", "version", "n"], "left_anti").select("id", "version", "n")


def dedupe_lines(
    docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None
) -> DataFrame:
    """``docs`` with near-equal lines removed from ``text``, and ``n_lines, n_removed`` (long).

    Trimmed lines of ``min_chars`` code points or more that are within ``threshold`` edits are
    linked, and of each component of links one line stays: that of the smallest id, the first
    there. Shorter lines stay; with ``exact_chars``, those of so many code points or more are
    linked to their exact repeats. ``docs`` needs ``doc_id`` and ``text``; its columns are all
    returned, ``n_chars`` recounted if present, and columns named ``n_lines`` or ``n_removed``
    replaced. A null text stays null, with no lines; one whose lines all go becomes empty. A
    null id comes before all others. Rows that repeat an id and a text are decided alike.
    """
    removed = (
        duplicate_lines(docs, threshold, min_chars, exact_chars)
        .groupBy("id", "version")
        .agg(F.collect_set("n").alias("_removed"))
        .select(F.col("id").alias("_id"), F.col("version").alias("_version"), "_removed")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(text).alias("_version"),
    ).join(removed, ["_id", "_version"], "left")
    lines = F.split(text, "\n", -1)

    def without(each: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(each) - 1), F.col("_removed"))
        return F.array_join(F.transform(places, lambda i: F.get(each, i)), "\n")

    left = _let(lines, without)
    new = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(left)
    out = joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
            "n_removed": F.coalesce(F.size("_removed"), F.lit(0)).cast("long"),
            "_text": new,
        }
    )
    recount = {"n_chars": F.coalesce(F.length("_text"), F.lit(0)).cast("long")} if "n_chars" in kept else {}
    value = {"text": F.col("_text")} | recount
    return out.select(*[value[c].alias(c) if c in value else F.col(f"`{c}`") for c in kept], "n_lines", "n_removed")

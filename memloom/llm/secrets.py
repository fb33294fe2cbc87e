"""Secret scan: patterns, and two character Markov models, in DataFrame functions only.

The pattern kinds (assign, access, hex) come first. Other long tokens are scored by the log of
how much likelier a first-order model of random strings makes them than one of ordinary
identifiers; both are trained from labelled samples. A token above ``ODDS`` is a ``markov`` span.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models score: runs of the characters of keys, base64 and identifiers.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
#: Symbols of the models; any other character is the symbol 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Least log-likelihood ratio (natural log), as for one secret in 1.2 million tokens.
ODDS = 14.0
#: Documents whose words are ordinary samples, chosen by a hash of their ids.
SAMPLE_DOCUMENTS = 512
#: Generated samples of each random kind.
SAMPLE_RANDOM = 1500
#: Words that identifiers are made of.
IDENTIFIER_WORDS = (
    "get set user name file path index value count list map key data node tree type class method object string "
    "array buffer stream reader writer server client request response handler manager factory builder config "
    "option default context session connection database table column query result error message event queue "
    "worker thread process memory cache version update delete insert create remove load store parse format "
    "encode decode validate register service controller module package import export test mock internal public"
).split()


def identifier_samples() -> list[str]:
    """Ordinary identifiers: words joined in the usual ways, dates, versions and numbers."""
    words, n, out = IDENTIFIER_WORDS, len(IDENTIFIER_WORDS), []
    for i in range(4 * n):
        a, b, c = words[i % n], words[(7 * i + 3) % n], words[(11 * i + 5) % n]
        out += [f"{a}_{b}_{c}", f"{a}{b.title()}{c.title()}", f"{a.title()}{b.title()}{c.title()}"]
        out += [f"{a}-{b}-{c}", f"{a}_{b}_{c}".upper(), f"{a}/{b}/{c}", f"{a}_{b}_{i}", a * 2 + b]
        out += [f"20{i % 100:02d}-{i % 12 + 1:02d}-{i % 28 + 1:02d}", f"{i * 7919 % 10**8:08d}", "=" * 20, "-" * 20]
    return out


def labelled_samples(docs: DataFrame) -> DataFrame:
    """``token, random``: generated random strings, made identifiers, and tokens of some documents.

    The tokens are those of sampled documents that no pattern matches, whatever their characters:
    what the corpus itself writes in file names, numbers and compounds counts as ordinary.
    """
    spark = docs.sparkSession
    seed = F.concat(F.lit("sample:"), F.col("id"))
    raw = F.unhex(F.sha2(seed, 256))
    b64 = F.base64(raw)
    made = spark.range(SAMPLE_RANDOM).select(
        F.explode(
            F.array(
                b64,
                F.regexp_replace(b64, "[+/=]", ""),
                F.translate(b64, "+/=", "-_"),
                F.sha1(seed),
                F.upper(F.sha1(seed)),
                F.translate(F.upper(b64), "+/=", ""),
            )
        ).alias("token"),
        F.lit(True).alias("random"),
    )
    fixed = spark.createDataFrame([(t, False) for t in identifier_samples()], "token string, random boolean")
    ids = [
        r[0]
        for r in docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_DOCUMENTS).collect()
    ]
    text = F.col("text").cast("string")
    words = (
        docs.where(F.col("doc_id").isin(ids) & ~text.rlike(f"{ASSIGN}|{HEX}|{ACCESS}"))
        .select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("token"))
        .select("token", F.lit(False).alias("random"))
    )
    return made.unionByName(fixed).unionByName(words)


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of symbols, first symbol times ``STATES`` plus second.

    Counts are smoothed by half. The table has ``STATES`` squared entries, whatever the samples.
    """
    chars = F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0))
    n = F.size("chars") - 1
    pair = F.zip_with(F.slice("chars", F.lit(1), n), F.slice("chars", F.lit(2), n), lambda x, y: F.concat(x, y))
    pairs = (
        samples.where("length(token) >= 2")
        .select("random", chars.alias("chars"))
        .select("random", F.explode(pair).alias("pair"))
        .select(
            "random",
            (F.instr(F.lit(ALPHABET), F.substring("pair", 1, 1)) * STATES
             + F.instr(F.lit(ALPHABET), F.substring("pair", 2, 1))).alias("cell"),
        )
        .groupBy("random", "cell")
        .count()
    )
    counts = {r: [[0.5] * STATES for _ in range(STATES)] for r in (True, False)}
    for row in pairs.collect():
        counts[row["random"]][row["cell"] // STATES][row["cell"] % STATES] += row["count"]
    logs = {r: [[math.log(x / sum(line)) for x in line] for line in table] for r, table in counts.items()}
    return [logs[True][i][j] - logs[False][i][j] for i in range(STATES) for j in range(STATES)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_ratio(token: Column, table: Column) -> Column:
    """The log-likelihood ratio of a token: the sum over its pairs of characters.

    A token is taken apart by pieces, so that a long one costs no more a character than a short one.
    """
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))

    def step(at: Column, char: Column) -> Column:
        now = F.instr(F.lit(ALPHABET), char)
        more = F.when(at["last"] >= 0, F.get(table, at["last"] * STATES + now)).otherwise(F.lit(0.0))
        return F.struct((at["sum"] + more).alias("sum"), now.alias("last"))

    pieces = F.regexp_extract_all(token, F.lit("(?s).{1,1024}"), F.lit(0))
    chars = lambda piece: F.regexp_extract_all(piece, F.lit("(?s)."), F.lit(0))
    return F.aggregate(pieces, start, lambda at, piece: F.aggregate(chars(piece), at, step), lambda at: at["sum"])


#: Lengths that are added up one by one; sums over such runs are added up apart.
RUN = 256


def running_sums(lengths: Column) -> Column:
    """The sum of an array of numbers up to each of them, by runs, so that no long array is copied for each."""
    none = F.expr("cast(array() as array<int>)")
    last = lambda sums: F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0))
    append = lambda sums, x: F.concat(sums, F.array(last(sums) + x))

    def apart(all_of: Column) -> Column:
        count = F.ceil(F.size(all_of) / RUN).cast("int")
        begin = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(none)
        return F.transform(begin, lambda k: F.aggregate(F.slice(all_of, k * RUN + 1, RUN), none, append))

    def joined(each: Column) -> Column:
        ends = F.aggregate(each, F.array(F.lit(0)), lambda sums, run: append(sums, last(run)))
        return _let(ends, lambda e: F.flatten(F.transform(each, lambda run, k: F.transform(run, lambda x: x + F.get(e, k)))))

    return _let(_let(lengths, apart), joined)


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches as structs of start and end, in code points.

    What stands between matches and the matches themselves alternate, so lengths add up to places.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def spans(t: Column) -> Column:
        ends = running_sums(F.zip_with(t["found"], F.slice(t["between"], F.lit(1), F.size(t["found"])), lambda x, y: x + y))
        return F.zip_with(ends, t["found"], lambda end, n: F.struct((end - n).alias("start"), end.alias("end")))

    return _let(F.struct(found.alias("found"), between.alias("between")), spans)


def _touches(spans: Column, s: Column) -> Column:
    """Whether a span overlaps one of ``spans``, which are in order and don't overlap: by halving."""

    def step(below: Column, power: Column) -> Column:
        k = below + F.call_function("shiftleft", F.lit(1), power)
        return F.when((k <= F.size(spans)) & (F.get(spans, k - 1)["start"] < s["end"]), k).otherwise(below)

    powers = F.sequence(F.ceil(F.log2(F.size(spans) + 1)).cast("int"), F.lit(0), F.lit(-1))
    before = F.aggregate(powers, F.lit(0), step)  # how many begin before the span ends
    return _let(before, lambda k: F.when(k > 0, F.get(spans, k - 1)["end"] > s["start"]).otherwise(False))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    name = lambda s: F.concat_ws(
        ":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )
    return F.array_join(F.transform(F.array_sort(spans), name), ",")


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, table: list[float], odds: float = ODDS) -> DataFrame:
    """Per document: ``doc_id``, counts, ``base_sha256`` and ``spans``; see :func:`find_secrets`."""
    text = F.col("text")
    ratios = F.split(F.lit(",".join(f"{x:.3f}" for x in table)), ",").cast("array<double>")
    rows = docs.select("doc_id", F.coalesce(text.cast("string"), F.lit("")).alias("text"))

    def with_text(pattern: str, group: int) -> Column:
        spoken = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.zip_with(matches(text, pattern), spoken, lambda s, x: F.struct(s["start"].alias("start"), s["end"].alias("end"), x.alias("text")))

    long_enough = F.filter(with_text(ASSIGN, 2), lambda s: F.length(s["text"]) >= 6)
    rows = rows.withColumns(
        {"_access": matches(text, ACCESS), "_hex": matches(text, HEX), "_assign": long_enough, "_tokens": with_text(TOKEN, 0)}
    )

    def added(all_of: Column) -> Column:
        free = lambda s: ~reduce(lambda a, b: a | b, [_touches(all_of[name], s) for name in KINDS[:3]])
        likely = lambda s: F.when(free(s), log_ratio(s["text"], all_of["ratios"]) >= odds).otherwise(False)
        return F.filter(all_of["tokens"], likely)

    # what the test of a token reads is bound once for a text
    bound = F.struct(F.col("_tokens").alias("tokens"), ratios.alias("ratios"), *[F.col(f"_{name}").alias(name) for name in KINDS[:3]])
    rows = rows.withColumn("_base", F.concat(*[_kind(F.col(f"_{name}"), i) for i, name in enumerate(KINDS[:3])]))
    rows = rows.withColumn("_markov", _let(bound, added))
    count = lambda name: F.size(f"_{name}").cast("long").alias(f"n_{name}")
    return rows.select(
        "doc_id",
        *[count(name) for name in KINDS],
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.concat(F.col("_base"), _kind(F.col("_markov"), 3))).alias("spans"),
    )


def find_secrets(docs: DataFrame, odds: float = ODDS) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A span is the whole match
    in code points, its end exclusive. Model spans are tokens that overlap no pattern span.
    A null text counts as empty: no spans, the SHA-256 of the empty text. Repeated rows each
    get a row; a null id stays null.
    """
    return scan(docs, train(labelled_samples(docs)), odds)

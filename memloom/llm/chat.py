"""Quotation linking for conversations, in DataFrame functions only.

Quote marks at the start of a line give its level. What a message quotes at each level is cut
into passages (sentences, so that rewrapped lines still match), normalised, hashed and joined
to the passages that earlier messages of the conversation wrote themselves. A message replies
to the one that wrote most of what it quotes at the first level, else to the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: A line's quote marks: "> ", ">>", "> > " and the like.
MARKS = r"^[\x20\t]*((?:>[\x20\t]?)+)"
#: A line like this just before a quote names its author and isn't the message's own text.
ATTRIBUTION = r"(wrote|schrieb|a écrit|escribió)\x20?:[\x20\t]*$"
#: Turns that a running value is taken over at once; longer conversations go on block by block.
BLOCK = 256


def latest(df: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """``df`` with the largest ``value`` in rows of the same keys and an earlier ``at``.

    Blocks of ``at`` are windowed apart and their maxima after that, so that a key with any
    number of rows is spread over tasks. Rows with equal ``at`` don't see each other.
    """
    blocked = df.withColumn("_block", F.floor(F.col(at) / BLOCK))
    before = Window.partitionBy(*keys, "_block").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max(value).alias("_most"))
        .withColumn("_so_far", F.max("_most").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "_block", "_so_far")
    )
    return (
        blocked.join(blocks, [*keys, "_block"], "left")
        .withColumn(out, F.greatest(F.max(value).over(before), F.col("_so_far")))
        .drop("_block", "_so_far")
    )


def parse(messages: DataFrame) -> DataFrame:
    """``messages`` with ``_lines``: per line its quote level and its text without the marks."""
    raw = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r?\n", -1)

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 1)
        level = F.length(marks) - F.length(F.regexp_replace(marks, ">", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, MARKS, "")).otherwise(x).alias("text"))

    lines = F.transform(raw, line)
    own = lambda x, i: ~(
        (x["level"] == 0) & x["text"].rlike(ATTRIBUTION) & (F.coalesce(F.get(F.col("_lines"), i + 1)["level"], F.lit(0)) > 0)
    )
    return messages.withColumn("_lines", lines).withColumn("_lines", F.filter("_lines", own))


def passages(level: Column) -> Column:
    """The distinct normalised sentences of the lines of one level, as pairs of hashes."""
    chosen = F.filter("_lines", lambda x: x["level"] == level)
    text = F.lower(F.regexp_replace(F.array_join(F.transform(chosen, lambda x: x["text"]), " "), r"\s+", " "))
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\x20"), F.trim), lambda s: s != "")
    return F.array_distinct(
        F.transform(sentences, lambda s: F.struct(F.xxhash64(s).alias("h1"), F.xxhash64(F.lit("passage"), s).alias("h2")))
    )


def links(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, level, original, passages``: who wrote what a message quotes.

    For each quoted passage the latest earlier message that wrote it counts; the one with most
    passages is the original of the level, the later one if two have as many.
    """
    whole = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    deepest = F.array_max(F.transform("_lines", lambda x: x["level"]))
    wrote = (
        whole.select("conv_id", "turn", F.explode(passages(F.lit(0))).alias("p"))
        .select("conv_id", "p.h1", "p.h2", "turn", F.lit(0).alias("level"), F.col("turn").alias("author"))
    )
    quoted = (
        whole.where(deepest > 0)
        .select("conv_id", "turn", "_lines", F.explode(F.sequence(F.lit(1), deepest)).alias("level"))
        .select("conv_id", "turn", "level", F.explode(passages(F.col("level"))).alias("p"))
        .select("conv_id", "p.h1", "p.h2", "turn", "level", F.lit(None).cast("long").alias("author"))
    )
    asked = quoted.select("conv_id", "h1", "h2").distinct()
    both = wrote.join(asked, ["conv_id", "h1", "h2"], "left_semi").unionByName(quoted).distinct()
    found = latest(both, ["conv_id", "h1", "h2"], "turn", "author", "original").where("level > 0 AND original IS NOT NULL")
    votes = found.groupBy("conv_id", "turn", "level", "original").agg(F.count("*").alias("passages"))
    return (
        votes.groupBy("conv_id", "turn", "level")
        .agg(F.max(F.struct("passages", "original")).alias("best"))
        .select("conv_id", "turn", "level", F.col("best.original").alias("original"), F.col("best.passages").alias("passages"))
    )


def reply_keys(turns: DataFrame, rounds: int = 40) -> DataFrame:
    """``conv_id, turn, reply_key`` for ``conv_id, turn, previous, parent``.

    A message whose parent isn't the one before it opens a branch right after its parent: its
    key is the parent's with its own turn added. What follows takes the key of its branch with
    its own turn as the last entry. Keys of branches of branches are joined by doubling.
    """
    jump = F.col("parent").isNotNull() & (F.col("parent") < F.col("previous"))
    marked = turns.withColumn("jump", F.when(jump, F.col("turn")))
    running = latest(marked, ["conv_id"], "turn", "jump", "_before").withColumn("branch", F.coalesce("jump", "_before"))
    running = checkpoint(running.select("conv_id", "turn", "parent", "jump", "branch"))
    opened = running.where("jump IS NOT NULL").select("conv_id", F.col("jump").alias("branch"), "parent")
    home = running.select("conv_id", F.col("turn").alias("parent"), F.col("branch").alias("up"))
    keys = checkpoint(
        opened.join(home, ["conv_id", "parent"]).select("conv_id", "branch", F.array("parent").alias("head"), "up")
    )
    for _ in range(rounds):
        if keys.where("up IS NOT NULL").isEmpty():
            break
        above = keys.select("conv_id", F.col("branch").alias("up"), F.col("head").alias("first"), F.col("up").alias("next"))
        keys = checkpoint(
            keys.join(above, ["conv_id", "up"], "left").select(
                "conv_id", "branch", F.concat(F.coalesce("first", F.array().cast("array<bigint>")), "head").alias("head"), F.col("next").alias("up")
            )
        )
    return running.join(keys.select("conv_id", "branch", "head"), ["conv_id", "branch"], "left").select(
        "conv_id", "turn", F.concat(F.coalesce("head", F.array().cast("array<bigint>")), F.array("turn")).alias("reply_key")
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, reply_key, turn, role, parent_turn, n_quoted, n_linked, text, formatted``.

    ``conversations`` needs ``conv_id, turn, role, text``; other columns are ignored. ``text``
    is what the message wrote itself; ``n_quoted`` counts quoted lines and ``n_linked`` passages
    joined to an original at any level. Rows are sorted by conversation and reply order across
    partitions. A message without id or turn stands alone, its key its turn. A null text is
    empty and a null role ``user``. Rows that repeat an id and a turn each give a row; their
    quotes are pooled.
    """
    messages = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    parsed = parse(messages)
    linked = checkpoint(links(parsed))
    turns = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    turns = latest(turns.withColumn("_turn", F.col("turn")), ["conv_id"], "turn", "_turn", "previous").drop("_turn")
    replies = linked.where("level = 1").select("conv_id", "turn", F.col("original").alias("quoted"))
    placed = checkpoint(
        turns.join(replies, ["conv_id", "turn"], "left").select(
            "conv_id", "turn", "previous", F.coalesce("quoted", "previous").alias("parent")
        )
    )
    keys = reply_keys(placed).join(placed.select("conv_id", "turn", F.col("parent").alias("parent_turn")), ["conv_id", "turn"])
    n_linked = linked.groupBy("conv_id", "turn").agg(F.sum("passages").alias("n_linked"))
    body = F.trim(F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["text"]), "\n"))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    role = F.coalesce("role", F.lit("user"))
    return (
        parsed.join(keys, ["conv_id", "turn"], "left")
        .join(n_linked, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            F.coalesce("reply_key", F.array("turn")).alias("reply_key"),
            "turn",
            role.alias("role"),
            "parent_turn",
            F.size(F.filter("_lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            body.alias("text"),
            F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n")).alias("formatted"),
        )
        .repartitionByRange("conv_id", "reply_key")
        .sortWithinPartitions("conv_id", "reply_key")
    )

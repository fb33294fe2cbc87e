"""The phrase index: which records a message calls up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ledger import saved, small


def phrase_index(phrases: DataFrame) -> DataFrame:
    """``tenant_id, phrase, memory_id``, normalised and without repeats or blanks."""
    return (
        phrases.select("tenant_id", T.collapsed(F.col("phrase")).alias("phrase"), "memory_id").where("phrase <> ''").distinct()
    )


def without(index: DataFrame, memory_ids: DataFrame) -> DataFrame:
    return index.join(memory_ids.select("memory_id").distinct(), "memory_id", "left_anti")


#: Longer texts aren't cut into all their substrings.
SUBSTRINGS_OF = 64


def _runs(df: DataFrame, text: str, k: int) -> DataFrame:
    """``df`` with ``piece``: a row for each different run of ``k`` characters of a text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda at: F.substring(F.col(text), at, F.lit(k)))
    return df.where(F.length(text) >= k).select(*df.columns, F.explode(F.array_distinct(runs)).alias("piece"))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """``tenant_id, short, long``: texts of a tenant that stand somewhere in others, both sides distinct.

    For few short and many long texts. A contained text shares all its runs of three characters, so it is looked up by the one of
    them that the long texts have least, and then verified; one of whose runs no text has is dropped
    at once. Runs of the long texts are counted and looked up as they are made, and not kept. A text of one or two characters is
    a run itself.
    """
    found: DataFrame | None = None
    for k in (1, 2):
        tiny = saved(short.where(F.length("short") == k).withColumn("piece", F.col("short")))
        hit = _runs(long, "long", k).join(small(tiny), ["tenant_id", "piece"]).select("tenant_id", "short", "long")
        found = hit if found is None else found.unionByName(hit)
    own = saved(_runs(short, "short", 3))
    pieces = saved(own.select("tenant_id", "piece").distinct())
    seen = _runs(long, "long", 3).join(small(pieces), ["tenant_id", "piece"], "left_semi").groupBy("tenant_id", "piece").agg(F.count("*").alias("n"))
    rarest = saved(
        own.join(seen, ["tenant_id", "piece"], "left")
        .groupBy("tenant_id", "short")
        .agg(F.min(F.when(F.col("n").isNotNull(), F.struct("n", "piece"))).alias("least"), F.count("*").alias("all"), F.count("n").alias("found"))
        .where("found = all")
        .select("tenant_id", "short", F.col("least.piece").alias("piece"))
    )
    near = _runs(long, "long", 3).join(small(rarest), ["tenant_id", "piece"]).where(F.contains("long", F.col("short"))).select("tenant_id", "short", "long")
    return found.unionByName(near)


def containing(short: DataFrame, long: DataFrame) -> DataFrame:
    """The same for many short and few long texts: these are cut into all their substrings, so the short ones are looked up as they are.

    Those of over ``SUBSTRINGS_OF`` characters are looked up by runs.
    """
    n = F.length("long")
    cuts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda at: F.transform(F.sequence(F.lit(1), n - at + 1), lambda size: F.substring(F.col("long"), at, size)),
        )
    )
    few = saved(long.where(n.between(1, SUBSTRINGS_OF)).select("tenant_id", "long", F.explode(F.array_distinct(cuts)).alias("short")))
    found = short.join(small(few), ["tenant_id", "short"]).select("tenant_id", "short", "long")
    rest = saved(long.where(n > SUBSTRINGS_OF))
    return found if rest.isEmpty() else found.unionByName(contained(short, rest))


def lookup(messages: DataFrame, index: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys, phrase, memory_id, score``: 1.0 for a phrase among a message's words and pairs of
    words, else 0.7 for one that contains one of them or is contained in one; the best counts.

    Each distinct n-gram of a tenant is looked up once, and all lookups are equi-joins.
    """
    tasks = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = messages.select(*dict.fromkeys((*keys, "tenant_id", column))).repartition(tasks)
    said = saved(texts.select(*keys, "tenant_id", T.ngrams(F.col(column)).alias("_grams")))  # not yet a row each, which would repeat the keys
    grams = said.select(*keys, "tenant_id", F.explode("_grams").alias("gram"))
    distinct = saved(grams.select("tenant_id", "gram").where("gram <> ''").distinct())
    index = saved(index)
    phrases = saved(index.select("tenant_id", "phrase").distinct())
    exact = distinct.join(phrases.withColumn("gram", F.col("phrase")), ["tenant_id", "gram"]).withColumn("score", F.lit(1.0))
    within = containing(distinct.withColumnRenamed("gram", "short"), phrases.withColumnRenamed("phrase", "long"))
    around = contained(phrases.withColumnRenamed("phrase", "short"), distinct.withColumnRenamed("gram", "long"))
    near = within.select("tenant_id", F.col("short").alias("gram"), F.col("long").alias("phrase")).unionByName(
        around.select("tenant_id", F.col("long").alias("gram"), F.col("short").alias("phrase"))
    )
    best = exact.unionByName(near.withColumn("score", F.lit(0.7))).groupBy("tenant_id", "gram", "phrase").agg(F.max("score").alias("score"))
    called = saved(best.join(index, ["tenant_id", "phrase"]))
    return grams.join(small(called), ["tenant_id", "gram"]).groupBy(*keys, "phrase", "memory_id").agg(F.max("score").alias("score"))

"""From running text to facts, names and terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LEAST_FACT = 12


def facts(df: DataFrame, keys: Sequence[str], column: str, least: int = LEAST_FACT) -> DataFrame:
    """``keys, place, fact``: the sentences of a text that are long enough, each once in any case.

    A text none of whose sentences is long enough is one fact as a whole.
    """
    found = F.filter(T.sentences(F.col(column)), lambda s: F.length(s) >= least)
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(column)))
    low = F.transform(F.col("_f"), F.lower)
    first = F.filter(F.col("_f"), lambda s, i: F.array_position(low, F.lower(s)) == i + 1)
    rows = df.select(*keys, found.alias("_f")).select(*keys, F.posexplode(first).alias("place", "fact"))
    return rows.withColumn("place", F.col("place").cast("long"))


def names(text: Column, given: Column | None = None) -> Column:
    """Names of capitalised words, after the given keys, each once in order."""
    found = F.regexp_extract_all(text, F.lit(T.NAMES), F.lit(0))
    return F.array_distinct(found if given is None else F.concat(given, found))


def conflict_terms(text: Column) -> Column:
    """The distinct words of a text without punctuation at their edges."""
    return F.array_distinct(F.filter(F.transform(T.words(text), T.edge_stripped), lambda w: w != ""))


def conflicting(new: DataFrame, candidates: DataFrame, group: str, negations: Sequence[str] = T.NEGATIONS) -> DataFrame:
    """``memory_id, candidate_id``: candidates of a group that share terms with a new text, one of both negated.

    Joined on the terms and on which side is negated, so that no other pair is made.
    """
    no = F.array(*map(F.lit, negations))

    def side(df: DataFrame, name: str, flip: bool) -> DataFrame:
        rows = df.select(group, F.col("memory_id").alias(name), conflict_terms(F.col("content")).alias("_w"))
        negated = F.arrays_overlap("_w", no)
        return rows.select(group, name, (~negated if flip else negated).alias("_no"), F.explode(F.array_except("_w", no)).alias("_t"))

    joined = side(new, "a", False).join(side(candidates, "b", True), [group, "_no", "_t"]).where("a <> b")
    return joined.select(F.col("a").alias("memory_id"), F.col("b").alias("candidate_id")).distinct()

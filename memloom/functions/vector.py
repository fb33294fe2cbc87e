"""Column functions on embeddings held as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for missing, empty or zero vectors and for unequal lengths."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def pseudo_embedding(text: Column, dimensions: int) -> Column:
    """A deterministic stand-in for a model: numbers in [-1, 1] from SHA-256 of text and counter, scaled to length 1."""
    words = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit((dimensions - 1) // 8)),
            lambda k: F.transform(
                F.sequence(F.lit(0), F.lit(7)),
                lambda i: F.conv(F.substring(F.sha2(F.concat(text, k.cast("string")), 256), i * 8 + 1, F.lit(8)), 16, 10).cast("double")
                / F.lit(2147483647.5)
                - 1,
            ),
        )
    )
    raw = F.slice(words, 1, dimensions)
    # the components, and then the norm, are bound once
    sized = F.transform(F.array(raw), lambda v: F.struct(v.alias("v"), F.greatest(norm(v), F.lit(1e-12)).alias("n")))
    return F.get(F.transform(sized, lambda s: F.transform(s["v"], lambda x: x / s["n"])), F.lit(0))

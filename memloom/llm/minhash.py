"""Near-duplicate documents by HyperMinHash.

Each text is cut into distinct five-word shingles. A sketch deals their 64-bit hashes to 256
buckets and keeps, per bucket, the leading-zero count and ten mantissa bits of the least hash.
Bands of registers name candidates, a collision-corrected estimate of the Jaccard index drops
those that are far off, and full shingle sets confirm the rest.

Texts with equal sets are one node. In a bucket of nodes, each is first held against one hub,
so that a group of thousands of copies costs a star and not all pairs; nodes that are then still
in different components are compared block by block. Nothing is capped: pairs inside one
component cannot change a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from . import hashing
from .common import checkpoint, lookup, text_buffers, text_slices
from .components import bucket_links, components

SHINGLE = 5
BUCKETS = 256
MANTISSA = 10
BAND = 5
BANDS = BUCKETS // BAND
#: Candidates whose estimate is below this are not confirmed; it lies nine deviations under 0.75.
FAR_OFF = 0.5
_PROBES = np.random.Generator(np.random.PCG64(7)).integers(0, BUCKETS, (4096, BUCKETS)).astype(np.uint8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, rows = hashing.word_bounds(data, offsets)
    words = hashing.word_hashes(data, starts, ends, lower=True)
    runs = hashing.run_hashes(words, SHINGLE)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(np.array([hashing.sequence_hash(words[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 256 HyperMinHash registers for each set that isn't empty.

    A register is the leading-zero count times 1024 plus the mantissa. An empty one borrows
    from the first full one of a fixed sequence of places, so that small sets compare too.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    slot = owner * BUCKETS + (every >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    rest = ((every[first] << np.uint64(8)) >> np.uint64(12)) | np.uint64(0)  # 52 bits
    fraction, exponent = np.frexp(np.maximum(rest, 1).astype(np.float64))
    zeros = np.minimum(52 - exponent, 62)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out = np.full(len(sets) * BUCKETS, -1, np.int64)
    out[slot[first]] = zeros * (1 << MANTISSA) + mantissa
    out = out.reshape(len(sets), BUCKETS)
    full = out >= 0
    row, place = np.nonzero(~full)
    for probe in _PROBES:
        if not len(row):
            break
        source = probe[place]
        found = full[row, source]
        out[row[found], place[found]] = out[row[found], source[found]]
        row, place = row[~found], place[~found]
    for r, p in zip(row.tolist(), place.tolist(), strict=True):
        out[r, p] = out[r, np.flatnonzero(full[r])[0]]
    return out.astype(np.uint16)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = shingle_sets(*text_buffers(batch.column("text")))
        some = [i for i, s in enumerate(sets) if len(s)]
        sketch: list = [None] * len(sets)
        for i, r in zip(some, registers([sets[i] for i in some]), strict=True):
            sketch[i] = r.astype(">u2").tobytes()
        with np.errstate(over="ignore"):
            name = [
                (int(s.sum().view(np.int64)), int(hashing.mix(s + np.uint64(1)).sum().view(np.int64)))
                for s in sets
            ]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "h1": pa.array([x for x, _ in name], pa.int64()),
                "h2": pa.array([x for _, x in name], pa.int64()),
                "sketch": pa.array(sketch, pa.binary()),
            }
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = shingle_sets(*text_buffers(batch.column("text")))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
            }
        )


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, sketch``: set size, a 128-bit name of the set, registers."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _sketches, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"
    )


def chance(n: np.ndarray) -> np.ndarray:
    """How likely the least of ``n`` hashes dealt to the buckets has each leading-zero count."""
    each = np.maximum(1.0, n / BUCKETS)[:, None]
    k = np.arange(63)[None, :]
    return (1 - 0.5 ** (k + 1)) ** each - (1 - 0.5**k) ** each


def estimate(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard indexes from registers, less what equal registers of unequal hashes add."""
    x = np.frombuffer(b"".join(a), ">u2").reshape(len(a), BUCKETS)
    y = np.frombuffer(b"".join(b), ">u2").reshape(len(b), BUCKETS)
    collide = (chance(na) * chance(nb)).sum(1) / (1 << MANTISSA)
    return ((x == y).mean(1) - collide) / (1 - collide)


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    return pd.Series(estimate(list(a), list(b), na.to_numpy(float), nb.to_numpy(float)))


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True))
            for x, y in zip(a, b, strict=True)
        ],
        dtype="int64",
    )


def _shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, shingles`` (a packed sorted set) of the documents in ``wanted``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.join(lookup(checkpoint(wanted)), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = shingle_sets(*text_buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(batch.column("doc_id").to_numpy(), [len(s) for s in sets]), pa.int64()),
                pa.array(np.concatenate(sets).view(np.int64), pa.int64()),
            ],
            names=["node", "shingle"],
        )


def _reach(docs: DataFrame, nodes: DataFrame, percent: int, members: DataFrame) -> DataFrame:
    """``node, size, reach``: set sizes, and the largest set that each node can be linked with.

    Only shingles that also occur in another component among ``members`` can be common to a
    link. If a node has s of them and n in all, then common <= s, and 100 * common >= percent *
    union gives n + m <= s * (100 + percent) / percent for a partner of m shingles.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = members.select(F.col("node").alias("doc_id"))
    each = rows.join(lookup(own), "doc_id", "left_semi").mapInArrow(_unpacked, "node long, shingle long")
    each = each.join(lookup(members), "node")
    common = (
        each.groupBy("shingle")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo < hi")
        .select("shingle")
    )
    shared = each.join(common, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("s"))
    sizes = nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"))
    return sizes.join(shared, "node").select(
        "node", "size", F.floor(F.col("s") * (100 + percent) / percent - F.col("size")).alias("reach")
    )


#: Shingles, and documents, in a block; two blocks are compared in one task.
BLOCK_SHINGLES = 150_000
BLOCK_NODES = 1_500


def spanning_links(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what is similar between the sides (or at all, if there is one side).

    Common shingles are counted by matrix products over slices of the vocabulary. Of each group
    that links hold together only a link of each node to the first is returned.
    """
    sizes = np.array([len(s) for s in sets], np.float32)
    vocabulary, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, len(vocabulary), 2048):
        a, b = np.searchsorted(token, [begin, begin + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[a:b], token[a:b] - begin] = 1
        common += part @ part.T
    near = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if len(set(side.tolist())) > 1:
        near &= side[:, None] != side[None, :]
    label = np.arange(len(sets), dtype=np.int32)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], np.int32(len(sets))).min(1))
        if (least == label).all():
            break
        label = least
    return [(int(nodes[i]), int(nodes[k])) for i, k in enumerate(label) if i != k]


def _block_links(docs: DataFrame, nodes: DataFrame, many: DataFrame, percent: int) -> DataFrame:
    """Links among the nodes of buckets: of those that can be linked at all, block by block.

    Buckets that share nodes form a group. A group is cut into blocks of bounded size, and each
    pair of blocks is compared in a task of its own that returns a spanning set of links.
    """
    members = checkpoint(many.select("node", "component").distinct())
    sized = checkpoint(many.join(_reach(docs, nodes, percent, members), "node"))
    least = sized.groupBy("bucket").agg(F.min("size").alias("least"))
    alive = checkpoint(sized.join(least, "bucket").where("reach >= least").select("bucket", "node", "size"))
    first = alive.groupBy("bucket").agg(F.min("node").alias("b"))
    groups = components(alive.join(first, "bucket").select(F.col("node").alias("a"), "b"))
    placed = alive.select("node", "size").distinct().join(
        groups.select(F.col("id").alias("node"), F.col("component").alias("group")), "node"
    )
    blocks = placed.groupBy("group").agg(
        F.ceil(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count("*") / BLOCK_NODES)).cast("int").alias("blocks")
    )
    tasks = (
        placed.join(blocks, "group")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "group", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    )
    sets = _shingles(docs, placed.select(F.col("node").alias("doc_id")).distinct())

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["node", "shingles"]).sort_values("node")
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        found = spanning_links(rows["node"].to_numpy(), sets, rows["block"].to_numpy(), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return (
        tasks.join(sets.withColumnRenamed("doc_id", "node"), "node")
        .groupBy("group", "x", "y")
        .applyInPandas(compare, "a long, b long")
    )


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    side = lambda x: nodes.select(
        F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")
    )
    near = checkpoint(
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(_estimate("sa", "sb", F.col("na"), F.col("nb")) >= FAR_OFF)
        .select("a", "b", "na", "nb")
    )
    wanted = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    sets = _shingles(docs, wanted)
    both = near.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb")), "b").join(
        sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), "a"
    )
    size = F.col("common")
    return (
        both.select("a", "b", "na", "nb", _common("xa", "xb").alias("common"))
        .where(100 * size >= percent * (F.col("na") + F.col("nb") - size))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Texts whose Jaccard index
    of shingle sets is ``percent`` hundredths or more are linked, and a component is named by
    its smallest id; ``kept`` marks the document of that id. A null or wordless text has no
    shingles and stands alone. A row with a null id gets a null component and is kept. Rows
    that repeat an id each give a row, and what any of their texts links is linked.
    """
    sketched = checkpoint(sketches(docs))
    full = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = checkpoint(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")))
    nodes = full.join(same.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    bands = nodes.select(
        F.col("doc_id").alias("node"),
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda k: F.xxhash64(k, F.substring(F.col("sketch"), k * (2 * BAND) + 1, F.lit(2 * BAND))),
            )
        ).alias("band"),
    )
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpoint(bands.join(shared, "band").select(F.col("band").alias("bucket"), "node"))
    linked = bucket_links(
        met,
        lambda pairs: _confirmed(pairs, nodes, docs, percent),
        lambda many: _block_links(docs, nodes, many, percent),
    )

    owned = full.join(same.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node")
    repeated = (
        owned.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    )
    again = owned.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    final = components(linked.union(again))
    label = final.withColumnRenamed("id", "node")
    named = (
        sketched.join(same.select("h1", "h2", "node"), ["h1", "h2"], "left")
        .withColumn("node", F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")))
        .join(label, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    )
    return named.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )

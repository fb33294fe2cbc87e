"""Vector code compression: product codes in whole numbers, with codebooks searched by kd-trees.

Each round broadcasts one kd-tree for each codebook. The search visits the nearer half of a
node first and the other one where its bound is not above the best distance so far: equal
bounds are visited too, so that of equally near entries the one of lower index is found. The
entries' new places are sums and counts, added up by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lookup, saved

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Entries of a leaf.
LEAF = 2
#: Components that a task holds at once.
SLICE_VALUES = 1 << 20


class Tree:
    """A kd-tree over the entries of a codebook; a node knows the box around its entries."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        self.index = np.arange(len(entries)) if index is None else index  # ascending
        own = entries[self.index]
        self.low, self.high = own.min(axis=0), own.max(axis=0)
        self.sides: tuple[Tree, ...] = ()
        self.entries = own
        if len(own) > LEAF:
            axis = int((self.high - self.low).argmax())
            order = self.index[np.argsort(own[:, axis], kind="stable")]
            self.sides = tuple(Tree(entries, np.sort(half)) for half in np.array_split(order, 2))

    def bound(self, points: np.ndarray) -> np.ndarray:
        """The least squared distance that an entry of this node may have."""
        beyond = np.maximum(self.low - points, 0) + np.maximum(points - self.high, 0)
        return np.einsum("ij,ij->i", beyond, beyond)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry's index and squared distance, for each point."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.index) + int(self.index.max()))
        self._search(points, np.arange(len(points)), best, index)
        return index, best

    def _search(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        if not self.sides:
            for k, entry in zip(self.index.tolist(), self.entries, strict=True):
                apart = points[rows] - entry
                d = np.einsum("ij,ij->i", apart, apart)
                closer = (d < best[rows]) | ((d == best[rows]) & (k < index[rows]))
                best[rows[closer]], index[rows[closer]] = d[closer], k
            return
        left, right = self.sides
        from_left, from_right = left.bound(points[rows]), right.bound(points[rows])
        first = from_left <= from_right
        left._search(points, rows[first], best, index)
        right._search(points, rows[~first], best, index)
        then = first & (from_right <= best[rows])
        right._search(points, rows[then], best, index)
        then = ~first & (from_left <= best[rows])
        left._search(points, rows[then], best, index)


def _whole(column: pa.Array, length: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and whole-number vectors, for each length that occurs; vectors with nulls or non-finite numbers are left out."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    valid = np.asarray(values.is_valid())
    numbers = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    valid &= np.isfinite(numbers)
    ends = np.cumsum(sizes)
    bad = np.append(0, np.cumsum(~valid))
    usable = (sizes > 0) & (sizes % PARTS == 0) & (bad[ends] == bad[ends - sizes])
    found = []
    for n in np.unique(sizes[usable]).tolist() if length is None else [length]:
        rows = np.flatnonzero(usable & (sizes == n))
        most = float(isqrt((1 << 63) // n) // 2 - 1)  # so that a vector's error fits a long
        taken = numbers[(ends - sizes)[rows][:, None] + np.arange(n)]
        # Numbers near the largest double pass over it when scaled.
        with np.errstate(over="ignore"):
            found.append((rows, np.clip(np.floor(SCALE * taken), -most, most).astype(np.int64)))
    return found


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of so many components at most, one row at least."""
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column("vector").value_lengths().fill_null(0)))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_VALUES, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice and length of vectors: how many, and those of the smallest ids, ``ENTRIES`` at most."""
    for batch in _slices(batches):
        ids = batch.column("vec_id").to_pylist()
        for rows, vectors in _whole(batch.column("vector")):
            own = sorted((ids[r] is None, ids[r] or 0, vectors[k].tolist()) for k, r in enumerate(rows.tolist()))[:ENTRIES]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([vectors.shape[1]] * len(own), pa.int32()),
                    pa.array([len(rows)] + [0] * (len(own) - 1), pa.int64()),
                    pa.array([None if gone else i for gone, i, _ in own], pa.int64()),
                    pa.array([v for _, _, v in own], pa.list_(pa.int64())),
                ],
                ["length", "n", "vec_id", "vector"],
            )


def train(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks, part by entry by component; None if no vector can be used.

    ``vectors`` has ``vec_id`` and ``vector``. What comes to the driver is one codebook's worth
    of vectors at the start and of sums each round, whatever the number of vectors.
    """
    firsts = checkpoint(vectors.mapInArrow(_firsts, "length int, n long, vec_id long, vector array<long>"))
    commonest = firsts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "length").first()
    if commonest is None:
        return None
    seeds = firsts.where(F.col("length") == commonest["length"]).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES)
    books = np.array([r["vector"] for r in seeds.collect()], np.int64)
    books = books.reshape(len(books), PARTS, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    size = books.shape[2]
    trees = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ((_, whole),) = _whole(batch.column("vector"), PARTS * size)
            for part, tree in enumerate(trees.value):
                points = whole.reshape(len(whole), PARTS, size)[:, part]
                index, _ = tree.nearest(points)
                used = np.unique(index)
                # Sums of a slice fit a long: 2^20 components of 2^31 at most.
                total = [[part, int(k), int((index == k).sum()), points[index == k].sum(axis=0).tolist()] for k in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t[j] for t in total], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                    ["part", "entry", "n", "total"],
                )

    found = vectors.mapInArrow(sums, "part int, entry int, n long, total array<long>")
    # Decimals, since the sum of all vectors may not fit a long.
    wide = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"t{j}") for j in range(books.shape[2])]
    books = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():
        books[r["part"], r["entry"]] = [int(r[f"t{j}"]) // r["n"] for j in range(books.shape[2])]
    trees.destroy()
    return books


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: ``vec_id, label, code, error, label_error, codebooks_sha256``.

    ``embeddings`` needs ``vec_id``, ``embedding`` and ``label``; other columns are ignored.
    Vectors that are null or empty, that hold a null or a number that isn't finite, or whose
    length isn't a multiple of 8 are dropped; so are those of another length than the commonest
    (of two, the shorter). Components so large that the error of a vector might not fit a long
    are taken as the nearest that can't. A missing id comes after all others, and of equal ids
    the smaller vector first. With fewer than 16 vectors the codebooks have fewer entries, and
    equal entries are used by the lower index. Repeated rows are coded each. A label's error
    that doesn't fit a long is null. An empty table gives no rows.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("vector"))
    books = train(vectors.select("vec_id", "vector"), rounds)
    label = embeddings.schema["label"].dataType.simpleString()
    if books is None:
        return embeddings.sparkSession.createDataFrame(
            [], f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string"
        )
    size = books.shape[2]
    trees = embeddings.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ((rows, whole),) = _whole(batch.column("vector"), PARTS * size)
            digits = np.zeros((len(rows), PARTS), np.uint8)
            error = np.zeros(len(rows), np.int64)
            for part, tree in enumerate(trees.value):
                index, best = tree.nearest(whole.reshape(len(whole), PARTS, size)[:, part])
                digits[:, part] = index
                error += best
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(rows)) for c in ("vec_id", "label")),
                    pa.array([d.tobytes().hex() for d in digits], pa.string()),
                    pa.array(error),
                ],
                ["vec_id", "label", "code", "error"],
            )

    coded = saved(vectors.mapInArrow(code, f"vec_id long, label {label}, code string, error long"))
    trees.destroy()
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(total)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(lookup(totals), F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )

"""Benchmark decontamination by latent semantic retrieval.

Passages of 24 words, and shorter ones for short items, are weighed by TF-IDF, with document
frequencies of the whole corpus, and projected on the leading right singular vectors of all of
them, which a distributed randomised SVD finds. Only words that the benchmark has are
projected; the others are taken as directions of their own, at right angles to all of these, and
lower a passage's cosine by their share of its weight. Passages of documents whose cosine with one
of a benchmark item is high are candidates. They are verified on words: the longest common
subsequence with the item, of content words, and how much of the item's answer is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import checkpoint, lookup, text_buffers, text_slices

#: Cells that words are hashed to for their document frequencies.
DIMS = 1 << 17
RANK = 128
OVERSAMPLE = 8
POWER_STEPS = 2
PASSAGE = 24
STRIDE = 12
#: Items of fewer words are searched by shorter passages as well (words, stride), of half to twice their size.
SHORT_ITEM = 15
#: Items of more words are searched by parts of so many.
LONG_ITEM = 512
SHORT_PASSAGES = ((3, 1), (6, 2), (8, 2), (12, 3))
#: The SVD is fitted on the products of words over all passages of all documents, in whole numbers of one part in so many.
UNIT = 1 << 30
#: Pairs of words that a task merges at once at least, that it holds before it hands them on, and those of a block, about.
MERGED_AT, TASK_PAIRS, BLOCK_PAIRS = 1 << 19, 1 << 22, 1 << 21
#: Numbers of a dense piece of the products.
DENSE = 1 << 22
#: Words in a larger share of the documents weigh nothing, unless too few of the benchmark's are left.
STOP_SHARE = 0.1
KEPT_SHARE = 0.25
#: The share of the weight of all fitted rows that the benchmark's own passages have at least.
BENCHMARK_SHARE = 1 / 9
#: Least cosine of a candidate; low, since the words decide. Higher for items of few different words, which chance orders.
COSINE, COSINE_OF_FEW = 0.45, 0.6
#: What the squared weight of words that the benchmark doesn't have counts in a passage's length.
OUTSIDE = 0.5
#: A leak has this share of the item's content words in order, or the lower one and the answer. Where an item has so
#: many different content words, and no fewer than half of them are, a half is enough: chance doesn't order so many.
OVERLAP = 0.8
OVERLAP_WITH_ANSWER = 0.6
OVERLAP_OF_MANY, MANY_WORDS = 0.5, 9
ANSWER = 0.6
#: Items that are held against all documents in one pass; more take more passes.
ITEMS_AT_ONCE = 20_000


@dataclass(frozen=True)
class Item:
    """A benchmark item: its content words, where each may match, and its answer's words."""

    item_id: int
    size: int
    content: int
    masks: dict[int, int]
    answer: int
    answer_masks: dict[int, int]


@dataclass(frozen=True)
class Scale:
    """Passages of one length: the words that the items searched by them have, and the items' passages."""

    length: int
    stride: int
    known: np.ndarray
    queries: np.ndarray
    owner: np.ndarray


@dataclass(frozen=True)
class Index:
    """The benchmark's words, sorted, their vectors (weight times projection), all words' weights, and the items' passages by scale."""

    vocabulary: np.ndarray
    vectors: np.ndarray
    weights: np.ndarray
    scales: list[Scale]
    items: list[Item]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits) without punctuation and case, and the text of each."""
    starts, ends, rows = hashing.word_bounds(data, offsets, hashing.NOT_ALPHANUMERIC)
    return hashing.word_hashes(data, starts, ends, lower=True), rows


def _dims(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(47)).astype(np.int64)


def places(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Where each word stands in a sorted vocabulary, its length if it doesn't."""
    out = np.full(len(words), len(vocabulary), np.int64)
    if len(vocabulary):
        some = np.zeros(DIMS, bool)
        some[_dims(vocabulary)] = True
        may = np.flatnonzero(some[_dims(words)])
        at = np.minimum(np.searchsorted(vocabulary, words[may]), len(vocabulary) - 1)
        hit = vocabulary[at] == words[may]
        out[may[hit]] = at[hit]
    return out


def passages(rows: np.ndarray, n: int, length: int = PASSAGE, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of the passages of ``n`` texts: every ``stride`` words, and the last."""
    bounds = np.searchsorted(rows, np.arange(n + 1))
    size = np.diff(bounds)
    count = np.where(size == 0, 0, np.where(size <= length, 1, -(-(size - length) // stride) + 1))
    owner = np.repeat(np.arange(n), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * stride, np.maximum(size[owner] - length, 0)) + bounds[owner]
    return start, owner


def project(cells: np.ndarray, start: np.ndarray, end: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Unit vectors of the passages from ``start`` to ``end``; zero where no word counts.

    ``cells`` are rows of ``vectors``, the last of which stands for words that don't count.
    """
    counted = np.flatnonzero(cells < len(vectors) - 1)
    first, last = np.searchsorted(counted, start), np.searchsorted(counted, end)
    size = last - first
    out = np.zeros((len(start), vectors.shape[1]), np.float32)
    some = np.flatnonzero(size)
    if len(some):
        size = size[some]
        begins = np.cumsum(size) - size
        flat = np.arange(size.sum()) - np.repeat(begins - first[some], size)
        out[some] = np.add.reduceat(vectors[cells[counted[flat]]], begins, axis=0)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed word occurs, over all documents, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in text_slices(batches):
            words, rows = words_of(*text_buffers(batch.column("text")))
            total += np.bincount(np.unique(rows * DIMS + _dims(words)) % DIMS, minlength=DIMS)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some := np.flatnonzero(total), -1), pa.int32()), pa.array(np.append(total[some], n))], names=["dim", "n"]
        )

    found = (
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(count, "dim int, n long")
        .groupBy("dim")
        .agg(F.sum("n").alias("n"))
        .toArrow().to_pandas()  # DIMS + 1 rows
    )
    df = np.zeros(DIMS + 1, np.int64)
    df[found["dim"].to_numpy(int) + 1] = found["n"].to_numpy(np.int64)
    return df[1:], int(df[0])


def pair_sums(words: np.ndarray, rows: np.ndarray, n: int, vocabulary: np.ndarray, weights: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """What the passages of ``n`` texts add to A'A, A their unit TF-IDF rows over a vocabulary, and the number of passages.

    Pairs of words are named by first * size + second, first <= second, once each. Products are
    whole numbers of ``UNIT``, so that sums don't depend on how the texts are dealt to tasks.
    """
    size = len(vocabulary)
    cells = places(words, vocabulary)
    start, owner = passages(rows, n)
    end = np.minimum(start + PASSAGE, np.searchsorted(rows, owner, "right"))
    inside = np.concatenate([[0], np.cumsum(cells < size)])
    use = inside[end] - inside[start] > 1
    start, end = start[use], end[use]
    heavy = np.append(weights > 0, False)
    at = np.flatnonzero(heavy[cells])
    first, count = np.searchsorted(at, start), np.searchsorted(at, end) - np.searchsorted(at, start)
    first, count = first[count > 0], count[count > 0]
    if not len(first):
        return int(use.sum()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.cumsum(count) - count
    within = np.arange(count.sum()) - np.repeat(begins, count)
    cell = cells[at[np.repeat(first, count) + within]]
    weight = weights[cell]
    value = weight / np.repeat(np.sqrt(np.add.reduceat(weight * weight, begins)), count)
    left = np.repeat(count, count) - within
    keys, sums = [], []
    for step in range(int(count.max())):
        one = np.flatnonzero(left > step)
        other = one + step
        low, high = np.minimum(cell[one], cell[other]), np.maximum(cell[one], cell[other])
        product = np.rint(value[one] * value[other] * UNIT).astype(np.int64)
        keys.append(low * size + high)
        sums.append(np.where((low == high) & (step > 0), 2 * product, product))
    return int(use.sum()), *_added(np.concatenate(keys), np.concatenate(sums))


def _added(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, with the sum of its numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(sums[order], begins) if len(keys) else sums


class _Sums:
    """Sums by key that grow by arrays; the newer ones are merged when they are as many as the older."""

    def __init__(self) -> None:
        self.n, self.old, self.new, self.waiting = 0, (np.zeros(0, np.int64),) * 2, [], 0

    def add(self, n: int, keys: np.ndarray, sums: np.ndarray) -> None:
        self.n += n
        self.new.append((keys, sums))
        self.waiting += len(keys)
        if self.waiting > max(len(self.old[0]), MERGED_AT):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.old, *self.new]
        self.old, self.new, self.waiting = _added(*(np.concatenate(x) for x in zip(*parts, strict=True))), [], 0
        return self.old


_SUMS = "block int, n long, keys binary, sums binary"


def _packed(block: int, n: int, keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())],
        names=["block", "n", "keys", "sums"],
    )


def word_products(docs: DataFrame, vocabulary: np.ndarray, weights: np.ndarray) -> DataFrame:
    """``block, n, keys, sums``: A'A over all passages of all documents, in packed rows of whole numbers (see ``pair_sums``).

    Each task adds up its own passages; the sums are shuffled by blocks of first words, so many
    that a block has at most about ``BLOCK_PAIRS`` pairs, and added up as they come in.
    """
    size = len(vocabulary)
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size * size // (2 * BLOCK_PAIRS)))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def parts(total: _Sums) -> Iterator[pa.RecordBatch]:
        keys, sums = total.merge()
        block = keys // max(size, 1) % blocks
        order = np.argsort(block, kind="stable")
        bounds = np.searchsorted(block[order], np.arange(blocks + 1)).tolist()
        yield _packed(0, total.n, keys[:0], sums[:0])
        for k in range(blocks):
            own = order[bounds[k] : bounds[k + 1]]
            if len(own):
                yield _packed(k, 0, keys[own], sums[own])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums()
        for batch in text_slices(batches):
            total.add(*pair_sums(*words_of(*text_buffers(batch.column("text"))), batch.num_rows, *shared.value))
            if len(total.old[0]) > TASK_PAIRS:
                yield from parts(total)
                total = _Sums()
        yield from parts(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums()
        for batch in batches:
            for n, keys, sums in zip(*(batch.column(c).to_pylist() for c in ("n", "keys", "sums")), strict=True):
                total.add(n, np.frombuffer(keys, np.int64), np.frombuffer(sums, np.int64))
        keys, sums = total.merge()
        if total.n or len(keys):
            yield _packed(0, total.n, keys, sums)

    texts = docs.select(F.col("text").cast("string").alias("text"))
    out = checkpoint(texts.mapInArrow(count, _SUMS).repartition(blocks, "block").mapInArrow(add, _SUMS))
    shared.destroy()
    return out


def _times(keys: np.ndarray, sums: np.ndarray, size: int, basis: np.ndarray, out: np.ndarray) -> None:
    """Add to ``out`` the product of these pairs of A'A with a basis, as dense rows of at most ``DENSE`` numbers at once."""
    first, second = keys // size, keys % size
    order = np.argsort(first, kind="stable")
    first, second, value = first[order], second[order], (sums[order] / UNIT).astype(np.float32)
    own, local = np.unique(first, return_inverse=True)
    step = max(1, DENSE // size)
    bounds = np.searchsorted(local, np.arange(0, len(own) + step, step)).tolist()
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        rows = own[k * step : (k + 1) * step]
        dense = np.zeros((len(rows), size), np.float32)
        dense[local[a:b] - k * step, second[a:b]] = value[a:b]
        out[rows] += dense @ basis[:size]
        dense[np.arange(len(rows)), rows] = 0
        out[:size] += dense.T @ basis[rows]


def singular_vectors(docs: DataFrame, extra: list[np.ndarray], vocabulary: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF rows, over a vocabulary, of all passages of all documents and of ``extra``.

    Strong ones are divided by their singular values, so that the few directions which all
    passages share weigh no more than those that tell passages apart.

    A small vocabulary is filled up with words that never occur. The documents are read once, for A'A; each power step
    sends the current basis to the tasks that hold it and adds up their products.
    """
    spark, size = docs.sparkSession, len(vocabulary)
    kept = word_products(docs, vocabulary, weights)
    small = weights.astype(np.float32)  # one kind of number throughout, else the sums below are slow

    def gram(rows: list[np.ndarray], basis: np.ndarray) -> np.ndarray:
        out = np.zeros_like(basis)
        for row in rows:
            scale = small[row] / max(float(np.sqrt((small[row] ** 2).sum())), 1e-9)
            np.add.at(out, row, scale[:, None] * (scale @ basis[row]))
        return out

    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(3)).standard_normal((max(size, RANK + OVERSAMPLE), RANK + OVERSAMPLE), np.float32))[0]
    own = list(extra)
    passages_of_all = kept.agg(F.sum("n")).first()[0] or 0
    boost = max(1.0, BENCHMARK_SHARE / (1 - BENCHMARK_SHARE) * passages_of_all / max(len(own), 1))
    for _ in range(POWER_STEPS + 1):
        shared = spark.sparkContext.broadcast(basis)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(shared.value)
            for batch in batches:
                for keys, sums in zip(batch.column("keys").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    if keys:
                        _times(np.frombuffer(keys, np.int64), np.frombuffer(sums, np.int64), size, shared.value, out)
            some = np.flatnonzero(out.any(1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {"cells": pa.array([some.tobytes()], pa.binary()), "sum": pa.array([out[some].astype(np.float32).tobytes()], pa.binary())}
            )

        total = boost * gram(own, basis)
        for r in kept.coalesce(4).mapInArrow(step, "cells binary, sum binary").collect():  # at most a matrix of fixed size from each of 4 tasks
            total[np.frombuffer(r["cells"], np.int32)] += np.frombuffer(r["sum"], np.float32).reshape(-1, total.shape[1])
        shared.destroy()
        last, basis = basis, np.linalg.qr(total)[0]
    core = (last.T @ total).astype(np.float64)
    square, turn = np.linalg.eigh((core + core.T) / 2)
    # Weak directions weigh as those of the mean: where nearly all are kept, they would tell parts of a passage apart.
    real = square[square > 1e-9 * max(float(square[-1]), 1e-12)]
    scale = np.sqrt(np.maximum(square, float(real.mean()) if len(real) else 1.0))
    return (last @ (turn / scale))[:, ::-1][:, :RANK]


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence with a text of ``size`` words, a word of bits a step."""
    full = (1 << size) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def parts_of(item_id: int, text: str, answer: str | None) -> list[tuple[int, str, str | None]]:
    """An item, or parts of about ``LONG_ITEM`` words of a long one, so that no mask of bits is longer."""
    words = text.split()
    if len(words) <= LONG_ITEM:
        return [(item_id, text, answer)]
    return [(item_id, " ".join(words[k : k + LONG_ITEM]), answer) for k in range(0, len(words), LONG_ITEM)]


def build(docs: DataFrame, items: list[tuple[int, str, str | None]], frequencies: tuple[np.ndarray, int]) -> Index:
    """The index of benchmark items (id, text, answer). Without an answer, the last quarter is it."""
    df, n = frequencies
    items = [part for item in items for part in parts_of(*item)]
    texts = pa.array([t for _, t, _ in items], pa.large_string())
    words, rows = words_of(*text_buffers(texts))
    own = df[_dims(words)]
    stop = max(STOP_SHARE * n, float(np.quantile(own, KEPT_SHARE))) if len(own) else STOP_SHARE * n
    weights = np.where(df > stop, 0.0, np.log((n + 1) / (df + 1)) + 0.1)
    vocabulary = np.unique(words)
    cells, heavy = places(words, vocabulary), weights[_dims(vocabulary)]
    start, owner = passages(rows, len(items))
    end = np.minimum(start + PASSAGE, np.searchsorted(rows, owner, "right"))
    basis = singular_vectors(docs, [cells[a:e] for a, e in zip(start.tolist(), end.tolist(), strict=True)], vocabulary, heavy)
    vectors = np.vstack([heavy[:, None] * basis[: len(vocabulary)], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    made = []
    bounds = np.searchsorted(rows, np.arange(len(items) + 1))
    for i, (item_id, _, answer) in enumerate(items):
        own = words[bounds[i] : bounds[i + 1]]
        telling = [int(w) for w, c in zip(own, cells[bounds[i] : bounds[i + 1]], strict=True) if heavy[c] > 0]
        content = telling if len(telling) >= 5 else [int(w) for w in own]
        if answer is not None:
            said, _ = words_of(*text_buffers(pa.array([answer], pa.large_string())))
            tail = [int(w) for w in said]
        else:
            tail = content[-max(1, len(content) // 4) :] if content else []
        made.append(Item(item_id, len(own), len(content), _masks(content), len(tail), _masks(tail)))
    queries = project(cells, start, end, vectors) if len(start) else np.zeros((0, basis.shape[1]), np.float32)
    size, scales = np.diff(bounds), []
    for length, stride in ((PASSAGE, STRIDE), *SHORT_PASSAGES):
        fit = size > 0 if length == PASSAGE else (size < SHORT_ITEM) & (2 * size >= length) & (size <= 2 * length)
        if fit.any():
            known = np.zeros(len(vocabulary) + 1, bool)
            known[cells[fit[rows]]] = True
            scales.append(Scale(length, stride, known, queries[fit[owner]], owner[fit[owner]]))
    return Index(vocabulary, vectors, weights, scales, made)


def _candidates(index: Index, words: np.ndarray, rows: np.ndarray, n: int) -> dict[tuple[int, int], list[tuple[float, int, int]]]:
    """The passages of ``n`` texts near one of an item, by text and item: cosine, first word, length.

    Words around a short item may outweigh it, so in short passages the words of no item of
    their scale weigh nothing. In those of ``PASSAGE`` words the cosine is lowered by the share of
    the weight that other words have; where that alone leaves too little, it isn't computed.
    """
    best: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    cells, squares = places(words, index.vocabulary), index.weights[_dims(words)] ** 2
    none = len(index.vocabulary)
    for scale in index.scales:
        start, owner = passages(rows, n, scale.length, scale.stride)
        end = np.minimum(start + scale.length, np.searchsorted(rows, owner, "right"))
        counted = scale.known[cells]
        known = np.concatenate([[0], np.cumsum(squares * counted)])
        inside = known[end] - known[start]
        share = np.ones(len(start))
        if scale.length == PASSAGE:
            whole = np.concatenate([[0], np.cumsum(squares)])
            outside = np.maximum(whole[end] - whole[start] - inside, 0)
            share = np.sqrt(inside / np.maximum(inside + OUTSIDE * outside, 1e-9))
        use = (inside > 1e-9) & (share >= COSINE)
        used = cells if scale.length == PASSAGE else np.where(counted, cells, none)
        start, end, owner, share = start[use], end[use], owner[use], share[use].astype(np.float32)
        for a in range(0, len(start), 2048):
            unit = project(used, start[a : a + 2048], end[a : a + 2048], index.vectors) * share[a : a + 2048, None]
            for q in range(0, len(scale.queries), 4096):
                cosine = unit @ scale.queries[q : q + 4096].T
                at = np.flatnonzero(cosine.ravel() >= COSINE)
                width = cosine.shape[1]
                for cell, c in zip(at.tolist(), cosine.ravel()[at].tolist(), strict=True):
                    i, k = a + cell // width, q + cell % width
                    best.setdefault((int(owner[i]), int(scale.owner[k])), []).append((c, int(start[i]), scale.length))
    return best


def _search(index: Index, words: np.ndarray, rows: np.ndarray, n: int) -> list[tuple[int, int, float, float, float]]:
    """Leaks in ``n`` texts: text, item, cosine, overlap, share of the answer."""
    if not len(words):
        return []
    bounds = np.searchsorted(rows, np.arange(n + 1)).tolist()
    out: dict[tuple[int, int], tuple[int, int, float, float, float]] = {}
    for (text, k), hits in _candidates(index, words, rows, n).items():
        item = index.items[k]
        different = len(item.masks)
        many = different >= MANY_WORDS and 2 * different >= item.content
        if not many:
            hits = [h for h in hits if h[0] >= COSINE_OF_FEW]
        spans: list[list[int]] = []  # the hit passages, widened by the item's size, where they touch one
        for at, length in sorted(h[1:] for h in hits):
            low, high = max(bounds[text], at - item.size), min(bounds[text + 1], at + length + item.size)
            if spans and low <= spans[-1][1] and high - spans[-1][0] <= 4 * item.size + 2 * length:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        found = None  # each span is decided by the rule; of those that meet it the best is told
        for low, high in spans:
            near = words[low:high].tolist()
            overlap = common_subsequence(item.masks, item.content, near) / max(item.content, 1)
            if overlap >= (OVERLAP_OF_MANY if many else OVERLAP_WITH_ANSWER):
                answer = common_subsequence(item.answer_masks, item.answer, near) / max(item.answer, 1)
                if many or overlap >= OVERLAP or answer >= ANSWER:
                    found = max(found or (0.0, 0.0), (overlap, answer))
        if found is not None:
            leak = (text, item.item_id, max(h[0] for h in hits), *found)
            out[text, item.item_id] = max(out.get((text, item.item_id), leak), leak, key=lambda x: x[3:])
    return [out[key] for key in sorted(out)]


_LEAKS = "doc_id long, item_id long, cosine double, overlap double, answer double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, overlap, answer``: the benchmark items found in documents.

    ``docs`` needs ``doc_id, text`` and ``benchmark`` ``item_id, text``, and may have
    ``answer``; other columns are ignored. Rows of ``docs`` without an id or text and items
    without words, or whose words are all in too many documents to weigh, give nothing. An item
    of over ``LONG_ITEM`` words is searched by parts, and a leak of a part is one of the item. Repeated rows each give rows; an item id that is repeated is
    searched once for each of its texts. All documents are searched in whole, for all items.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")
    ).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    parts = max(1, -(-items.count() // ITEMS_AT_ONCE))
    frequencies = document_frequencies(rows)
    out = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(build(rows, sorted(own.collect(), key=str), frequencies))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches):
                words, at = words_of(*text_buffers(batch.column("text")))
                found = _search(shared.value, words, at, batch.num_rows)
                ids = batch.column("doc_id").to_pylist()
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[t] for t in columns[0]], pa.int64()), pa.array(columns[1], pa.int64()),
                     *[pa.array(c, pa.float64()) for c in columns[2:]]],
                    names=["doc_id", "item_id", "cosine", "overlap", "answer"],
                )

        found = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(search, _LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without an id stay."""
    bad = checkpoint(leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct())
    return docs.join(lookup(bad), F.col("doc_id").cast("long") == F.col("_leaked"), "left_anti")

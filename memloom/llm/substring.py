"""Substring deduplication with an FM-index per shard.

A window is ``WINDOW`` consecutive words. Its anchor is the least hash among its runs of
``ANCHOR`` words, so equal windows have equal anchors wherever they stand. Windows next to each
other with one anchor form a segment. Segments whose anchor occurs more than once go, as word
hashes, to the shard of their anchor; of equal ones in a task only the first. A shard merges equal segments, builds a compressed
FM-index of the rest and streams them through it: backward search over the wavelet matrix gives
the interval of every window that occurs again, and the earliest place in it.

Windows of very frequent anchors are dealt out one by one by their outer words as well, so no
anchor gathers in one task; equal ones are combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import checkpoint, text_buffers, text_slices
from .fmindex import FMIndex

WINDOW = 20
ANCHOR = 6
#: Anchors that occur more often are dealt out by windows.
FREQUENT = 1000
#: Bytes of a word's hash that are sent; two words agree in all with odds of 1 to 2**48.
WORD_BYTES = 6
#: Words in one index; a shard builds one after another.
INDEX_WORDS = 400_000
#: Most bits of the broadcast filter of repeated anchors. Beyond, it lets more pass, never less.
FILTER_BITS = 28
LAST_ID = 2**63 - 1


def anchors(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows with one anchor: first window, number of windows, anchor.

    A window is named by its first word's place in ``words``; ``rows`` tells the text of each word.
    """
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    runs = hashing.run_hashes(words, ANCHOR)
    least, where = runs[:n].copy(), np.zeros(n, np.int16)
    for k in range(1, WINDOW - ANCHOR + 1):
        other = runs[k : k + n]
        less = other < least
        least[less] = other[less]
        where[less] = k
    place = where + np.arange(n)
    inside = rows[:n] == rows[WINDOW - 1 :]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (rows[1:n] != rows[: n - 1])
    first = np.flatnonzero(new & inside)
    breaks = np.append(np.flatnonzero(new), n)
    count = breaks[np.searchsorted(breaks, first, "right")] - first
    return first, count, least[first]


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffers(batch.column("text"))
    starts, ends, rows = hashing.word_bounds(data, offsets)
    return hashing.word_hashes(data, starts, ends), rows


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        _, _, anchor = anchors(*_words(batch))
        found, n = np.unique(anchor, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"]
        )


def anchor_filter(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two bit tables, of the anchors that occur again and of the frequent ones.

    They are indexed by the anchors' lowest bits, at least 16 bits an anchor up to the bound.
    """
    repeated = counts.count()
    bits = min(FILTER_BITS, max(16, (16 * repeated).bit_length()))
    tables = [np.zeros(1 << (bits - 6), np.int64) for _ in range(2)]
    cell = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))
    frequent = F.when(F.col("n") > FREQUENT, one).otherwise(F.lit(0).cast("long"))
    words = (
        counts.groupBy(F.shiftright(cell, 6).alias("word"))
        .agg(F.bit_or(one).alias("again"), F.bit_or(frequent).alias("often"))
        .toArrow().to_pandas()  # at most 2 ** (FILTER_BITS - 6) rows
    )
    for table, column in zip(tables, ("again", "often"), strict=True):
        table[words["word"].to_numpy(np.int64)] = words[column].to_numpy(np.int64)
    return tables[0].view(np.uint64), tables[1].view(np.uint64)


def _in_filter(table: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    cell = anchor & np.uint64(len(table) * 64 - 1)
    return (table[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


_SEGMENT = "key long, id long, version long, start long, windows int, words binary"


def _rows(key, ids, versions, start, windows, content) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(versions, pa.int64()),
         pa.array(start, pa.int64()), pa.array(windows, pa.int32()), pa.array(content, pa.binary())],
        names=["key", "id", "version", "start", "windows", "words"],
    )


#: Distinct segments that a task remembers at once, each by 16 bytes and its least place.
REMEMBERED = 100_000


def _segments(batches: Iterator[pa.RecordBatch], again: np.ndarray, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The segments of repeated anchors. One that an earlier row of the task has too is decided here.

    It gets no words, and a key of its own row, so that the copies of a passage neither travel
    nor meet in one shard: a shard gets the least of each task.
    """
    seen: dict[bytes, tuple[int, int]] = {}
    for batch in text_slices(batches):
        words, rows = _words(batch)
        first, count, anchor = anchors(words, rows)
        use = _in_filter(again, anchor)
        first, count, anchor = first[use], count[use], anchor[use]
        single = _in_filter(often, anchor)
        each = np.repeat(first[single], count[single])
        opened = np.cumsum(count[single]) - count[single]
        each = each + np.arange(len(each)) - np.repeat(opened, count[single])
        with np.errstate(over="ignore"):
            outer = hashing.mix(words[each] * np.uint64(31) + words[each + WINDOW - 1])
        key = np.concatenate([anchor[~single], np.repeat(anchor[single], count[single]) ^ outer])
        begin = np.concatenate([first[~single], each])
        count = np.concatenate([count[~single], np.ones(len(each), np.int64)])
        if not len(key):
            continue
        ids = np.array([LAST_ID if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
        versions = batch.column("version").to_numpy()
        row = rows[begin]
        start = begin - np.searchsorted(rows, np.arange(batch.num_rows))[row]
        raw = words.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
        content = [
            raw[a * WORD_BYTES : (a + c + WINDOW - 1) * WORD_BYTES]
            for a, c in zip(begin.tolist(), count.tolist(), strict=True)
        ]
        if len(seen) > REMEMBERED:
            seen.clear()
        own, key = ids[row], key.view(np.int64)
        for i in np.lexsort((start, own)).tolist():
            at, name = (int(own[i]), int(start[i])), hashlib.blake2b(content[i], digest_size=16).digest()
            least = seen.setdefault(name, at)
            if least < at:
                content[i] = None
                key[i] = hash((at, int(key[i])))
            else:
                seen[name] = at
        yield _rows(key, own, versions[row], start, count, content)


def _symbols(content: bytes) -> np.ndarray:
    out = np.zeros((len(content) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(content, np.uint8).reshape(-1, WORD_BYTES)
    return out.view(np.uint64)[:, 0]


def repeated_windows(segments: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """Of segments (id, version, start, words): the runs of windows that also start earlier."""
    parts = [_symbols(s[3]) for s in segments]
    lengths = np.array([len(p) for p in parts])
    begin = np.cumsum(lengths + 1) - lengths
    flat = np.concatenate(parts)
    _, dense = np.unique(flat, return_inverse=True)
    text = np.zeros(int((lengths + 1).sum()) + 1, np.int32)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin, lengths)
    text[inside] = dense + 1
    segment = np.repeat(np.arange(len(parts)), lengths)
    # the order of places: by id, then by word; a place that two segments hold is one
    ids = np.array([s[0] for s in segments])[segment]
    word = np.array([s[2] for s in segments])[segment] + inside - begin[segment]
    sort = np.lexsort((word, ids))
    new = np.ones(len(sort), bool)
    new[1:] = (np.diff(ids[sort]) != 0) | (np.diff(word[sort]) != 0)
    order = np.full(len(text), np.iinfo(np.int32).max, np.int32)
    order[inside[sort]] = np.cumsum(new)

    index = FMIndex(text, WINDOW)
    last = np.repeat(lengths - WINDOW, lengths)
    opens = inside[inside - begin[segment] <= last]
    low, high = index.search(text, opens + WINDOW, WINDOW)
    some = np.flatnonzero(high - low > 1)
    if not len(some):
        return
    lows, back = np.unique(low[some], return_inverse=True)
    highs = np.zeros(len(lows), np.int64)
    highs[back] = high[some]
    sorted_order = np.append(order[index.suffixes], np.int32(np.iinfo(np.int32).max))
    least = np.minimum.reduceat(sorted_order, np.ravel(np.column_stack([lows, highs])))[::2]
    flagged = np.sort(opens[some[least[back] < order[opens[some]]]])
    cut = np.flatnonzero(np.diff(flagged) != 1) + 1
    for run in np.split(flagged, cut) if len(flagged) else []:
        s = int(np.searchsorted(begin, run[0], "right")) - 1
        yield segments[s][0], segments[s][1], int(segments[s][2] + run[0] - begin[s]), len(run)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard in order of key, id and start, to the runs of windows to remove."""
    out: list[tuple[int, int, int, int]] = []
    held: list[tuple[int, int, int, bytes]] = []
    groups: list[tuple[int, int, int, bytes]] = []  # of keys that are complete
    seen: dict[bytes, tuple[int, int]] = {}
    size, key = 0, None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "version", "start", "windows"]
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "id", "version", "start", "windows", "words")]
        for k, i, version, start, windows, words in zip(*columns, strict=True):
            if words is None:  # decided where it was read
                out.append((i, version, start, windows))
                continue
            if k != key:
                if len(held) > 1:
                    groups += held
                    size += sum(len(h[3]) for h in held) // WORD_BYTES
                held, seen, key = [], {}, k
                if size > INDEX_WORDS:
                    out += repeated_windows(groups)
                    groups, size = [], 0
            if seen.setdefault(words, (i, start)) < (i, start):
                out.append((i, version, start, windows))
            else:
                held.append((i, version, start, words))
        if len(out) > 10_000:
            yield flush()
            out.clear()
    if len(held) > 1:
        groups += held
    if groups:
        out += repeated_windows(groups)
    yield flush()


def repeats(docs: DataFrame) -> DataFrame:
    """``id, version, start, windows``: runs of windows whose words also start earlier."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("version"),
        F.col("text").cast("string").alias("text"),
    )
    counts = checkpoint(
        rows.select("text")
        .mapInArrow(_count_anchors, "anchor long, n long")
        .groupBy("anchor")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
    )
    shared = docs.sparkSession.sparkContext.broadcast(anchor_filter(counts))
    cut = lambda batches: _segments(batches, *shared.value)
    sent = rows.mapInArrow(cut, _SEGMENT)
    return (
        sent.repartition("key")
        .sortWithinPartitions("key", "id", "start", F.col("words").isNull())
        .mapInArrow(_shard, "id long, version long, start long, windows long")
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        n_words, n_removed, kept = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for run in runs or []:
                gone[run["start"]] += 1
                gone[run["start"] + run["windows"] + WINDOW - 1] -= 1
            left = np.cumsum(gone[:-1]) == 0
            n_words.append(len(words))
            n_removed.append(int(len(words) - left.sum()))
            kept.append(b" ".join(words if not runs else [words[i] for i in np.flatnonzero(left).tolist()]).decode())
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept": pa.array(kept, pa.string()),
            }
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept``, the last the words left joined by spaces.

    Words covered by a window whose word sequence also starts earlier (smaller id, or the same
    text, earlier word) are removed; all windows are judged on the input. ``docs`` needs
    ``doc_id`` and ``text``; other columns are ignored. A null text has no words. A null id
    comes after all others. Of rows that repeat an id, windows at the same word don't count as
    earlier than each other.
    """
    runs = (
        repeats(docs)
        .groupBy("id", "version")
        .agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("version"),
        F.col("text").cast("string").alias("text"),
    )
    return (
        rows.join(runs, ["id", "version"], "left")
        .select("doc_id", "text", "runs")
        .mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept string")
    )


def digests(kept: DataFrame) -> DataFrame:
    """``kept`` as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

"""Merkle fingerprints of documents: root over sections over paragraphs over runs of words.

A paragraph is a line with its line end. It is cut into leaves of four words with what follows
them, a line of at most eight words into single words. A section ends at a blank line or at a
paragraph whose hash is a multiple of eight, so that an edit moves no far boundary. Equal roots
mean equal texts; where roots differ, differing branches lead to the edits.

A fingerprint reads ``root;section=paragraph+leaves,paragraph+leaves;section=...``: the root as
32 hexadecimal digits, sections and paragraphs as 8, each leaf as 4 characters of base64.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import SLICE_BYTES, text_buffers

LEAF_WORDS = 4
SHORT_LINE = 8
SECTION_EVERY = 8
_BASE64 = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)


def _group_hash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each run of ``values``, which begin at ``first``, in order."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = np.diff(np.append(first, len(values)))
    place = np.arange(len(values)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        return hashing.mix(np.add.reduceat(hashing.mix(values + place.astype(np.uint64)), first) + size.astype(np.uint64))


def trees(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The fingerprint of each text, and of all leaves the 24-bit code and the text it is in."""
    column = pa.array(texts, pa.large_string())
    data, offsets = text_buffers(column)
    starts, _, rows = hashing.word_bounds(data, offsets)
    lines = np.cumsum(data == 10)
    line = lines[starts] if len(starts) else starts
    new_line = np.ones(len(starts), bool)
    new_line[1:] = (rows[1:] != rows[:-1]) | (line[1:] != line[:-1])
    head = np.flatnonzero(new_line)
    length = np.diff(np.append(head, len(starts)))
    place = np.arange(len(starts)) - np.repeat(head, length)
    step = np.repeat(np.where(length > SHORT_LINE, LEAF_WORDS, 1), length)
    leaf = place % step == 0
    begins, owner, opens_line = starts[leaf].copy(), rows[leaf], new_line[leaf]
    # the first leaf of a text begins where the text does; a text of blanks only is one leaf
    first_of_text = np.ones(len(owner), bool)
    first_of_text[1:] = owner[1:] != owner[:-1]
    begins[first_of_text] = offsets[owner[first_of_text]]
    blank = np.setdiff1d(np.flatnonzero(np.diff(offsets) > 0), owner)
    if len(blank):
        order = np.argsort(np.concatenate([owner, blank]), kind="stable")
        begins = np.concatenate([begins, offsets[blank]])[order]
        opens_line = np.concatenate([opens_line, np.ones(len(blank), bool)])[order]
        owner = np.concatenate([owner, blank])[order]
    ends = np.append(begins[1:], len(data)) if len(begins) else begins
    hashes = hashing.word_hashes(data, begins, ends)
    codes = (hashes >> np.uint64(40)).astype(np.int64)

    paragraph = np.flatnonzero(opens_line)
    paragraph_hash = _group_hash(hashes, paragraph)
    paragraph_end = np.append(paragraph[1:], len(begins))
    newlines = np.diff(np.concatenate([[0], lines[ends[paragraph_end - 1] - 1]])) if len(paragraph) else paragraph
    closes = (newlines > 1) | (paragraph_hash % np.uint64(SECTION_EVERY) == 0)
    opens = np.ones(len(paragraph), bool)
    opens[1:] = closes[:-1] | (owner[paragraph[1:]] != owner[paragraph[:-1]])
    section = np.flatnonzero(opens)
    section_hash = _group_hash(paragraph_hash, section)

    spelled = _BASE64[(codes[:, None] >> np.array([18, 12, 6, 0])) & 63].tobytes().decode()
    short = lambda h: [f"{x:08x}" for x in (h >> np.uint64(32)).tolist()]
    pieces = [
        p + spelled[4 * a : 4 * b]
        for p, a, b in zip(short(paragraph_hash), paragraph.tolist(), paragraph_end.tolist(), strict=True)
    ]
    section_end = np.append(section[1:], len(paragraph))
    parts: list[list[str]] = [[] for _ in texts]
    digests = [hashlib.sha256() for _ in texts]
    of = owner[paragraph[section]].tolist() if len(section) else []
    for s, h, o, a, b in zip(short(section_hash), section_hash.tolist(), of, section.tolist(), section_end.tolist(), strict=True):
        parts[o].append(f"{s}={','.join(pieces[a:b])}")
        digests[o].update(h.to_bytes(8, "big"))
    roots = [d.hexdigest()[:32] for d in digests]
    return [";".join([r, *p]) for r, p in zip(roots, parts, strict=True)], codes, owner


def likeness(codes: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Of ``n`` pairs of texts, twice the common leaves over all leaves; 1 if neither has any."""
    (a, in_a), (b, in_b) = codes, others
    x, nx = np.unique((in_a << 24) | a, return_counts=True)
    y, ny = np.unique((in_b << 24) | b, return_counts=True)
    both, at_x, at_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = np.bincount(both >> 24, np.minimum(nx[at_x], ny[at_y]), minlength=n)[:n]
    total = np.bincount(in_a, minlength=n)[:n] + np.bincount(in_b, minlength=n)[:n]
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


def _branches(fingerprint: str) -> list[tuple[str, list[str]]]:
    return [(s[:8], s[9:].split(",")) for s in fingerprint.split(";")[1:]]


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Where the text of fingerprint ``a`` differs from that of ``b``: (section, paragraph) in ``a``.

    Equal roots end the search at once, and equal sections aren't looked into.
    """
    if a[:32] == b[:32]:
        return []
    theirs = Counter(s for s, _ in _branches(b))
    paragraphs = Counter(p for _, ps in _branches(b) for p in ps)
    out = []
    for i, (section, own) in enumerate(_branches(a)):
        if theirs[section] > 0:
            theirs[section] -= 1
            paragraphs.subtract(own)
            continue
        for k, p in enumerate(own):
            if paragraphs[p] > 0:
                paragraphs[p] -= 1
            else:
                out.append((i, k))
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """``bucket, extra, doc_id, text``, sorted so that each row is followed by the next document.

    Ids are cut into ranges at quantiles, each of which begins with an id that occurs. A range's
    first rows also go to the range before it (``extra`` 1), the very first ones to the last
    range. Rows without an id come apart (``extra`` 2). Only the cuts, one for each partition,
    pass through the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = [i / n for i in range(n)]
    found = rows.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", steps, 100 * n).alias("cuts")).first()
    cuts = np.array(sorted({found["low"], *(found["cuts"] or [])} - {None}), np.int64)
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("array<int>")
    def buckets(ids: pd.Series) -> pd.Series:
        """The ranges that a row goes to; minus one is its own range twice over, as an extra row."""
        at = shared.value
        known = ids.notna().to_numpy()
        values = ids.fillna(0).to_numpy(np.int64)
        if not len(at):
            return pd.Series([[0]] * len(ids))
        own = np.searchsorted(at, values, "right") - 1
        edge = known & (at[np.maximum(own, 0)] == values)
        return pd.Series([[o, (o - 1) % len(at)] if e else [o if k else 0] for o, e, k in zip(own.tolist(), edge.tolist(), known.tolist(), strict=True)])

    ranges = max(1, len(cuts))
    dealt = rows.withColumn("to", buckets("doc_id")).select(
        F.posexplode("to").alias("extra", "bucket"), "doc_id", "text"
    ).withColumn("extra", F.when(F.col("doc_id").isNull(), 2).otherwise(F.col("extra")))
    return dealt.repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", "extra", "doc_id", "text")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(rows: list[tuple], following: list[str]) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        edited = [(t[: len(t) - len(t) // 4] + f[: len(t) // 4]) for t, f in zip(texts, following, strict=True)]
        n = len(rows)
        names, codes, owner = trees(texts + edited + following)
        part = lambda k: (codes[m := (owner // max(n, 1) == k)], owner[m] - k * n)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([r[2] for r in rows], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                "fingerprint": pa.array(names[:n]),
                "edited_fingerprint": pa.array(names[n : 2 * n]),
                "near_edited": pa.array(likeness(part(0), part(1), n)),
                "near_next": pa.array(likeness(part(0), part(2), n)),
                "edited_at": pa.array([[f"{s}.{p}" for s, p in edits(a, b)] for a, b in zip(names[:n], names[n : 2 * n], strict=True)], pa.list_(pa.string())),
            }
        )

    waiting: tuple | None = None  # the row whose next document isn't known yet
    rows: list[tuple] = []
    following: list[str] = []
    size = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")]
        for row in zip(*columns, strict=True):
            if waiting is not None:
                rows.append(waiting)
                following.append(row[3] if row[0] == waiting[0] and row[1] < 2 else "")
                size += 3 * len(waiting[3]) + len(row[3])
            waiting = row if row[1] == 0 else None
            if row[1] == 2:
                rows.append(row)
                following.append("")
            if size > SLICE_BYTES // 2:
                yield done(rows, following)
                rows, following, size = [], [], 0
    if waiting is not None:
        rows.append(waiting)
        following.append("")
    if rows:
        yield done(rows, following)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256``, two fingerprints, two likenesses, ``edited_at``.

    ``edited_at`` names the paragraphs (section and paragraph, from 0) in which the text differs
    from the edited one, found by following the differing branches of the two trees.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. The edited text is the
    text with its last quarter of code points replaced by as many (or all) from the start of
    the next document in order of id, the first after the last. Rows that repeat an id are
    ordered by text. A row without an id has an empty next document. A null text is empty; two
    empty texts are alike (1).
    """
    return with_next(docs).mapInArrow(
        _fingerprints,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, edited_at array<string>",
    )

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language in every partition and sums the counts by group;
the matrix of log-probabilities (languages times ``DIMS``) is broadcast. Scoring is a sparse
product in numpy: the matrix rows of a text's n-grams are gathered and summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_buffers, text_slices

DIMS = 1 << 13
ORDERS = (1, 2, 3)
#: Languages in one matrix, which bounds a broadcast to 8 MB; more take more passes over a text.
LANGUAGES_AT_ONCE = 250
UNKNOWN = "und"
SMOOTHING = 0.5
#: Bytes of text scored at once.
CHUNK = 1 << 20
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def held_out(key: Column) -> Column:
    """Whether a row is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of UTF-8 bytes, and the byte at which each begins.

    Bytes that aren't UTF-8 give some code point or other, never an error.
    """
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[begin].astype(np.uint32)
    points = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, lead & 0x1F, lead & 0x0F], lead & 0x07)
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        more = data[np.minimum(begin + k, len(data) - 1)].astype(np.uint32) & 0x3F
        points = np.where(lead >= least, (points << 6) | more, points)
    points = np.where(points > 0x10FFFF, 0xFFFD, points)
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    return np.where(upper, points + 32, points).astype(np.uint32), begin


def _letters(points: np.ndarray) -> np.ndarray:
    """Letters as Python's str.isalpha has them; each distinct code point is asked once."""
    distinct, place = np.unique(points, return_inverse=True)
    return np.array([chr(p).isalpha() for p in distinct.tolist()], bool)[place]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the row of each, and which rows have a letter.

    What isn't a letter counts as a space and runs of spaces as one; n-grams don't cross rows.
    """
    points, begin = code_points(data)
    rows = np.searchsorted(offsets, begin, "right") - 1
    letter = _letters(points) if len(points) else np.zeros(0, bool)
    points = np.where(letter, points, np.uint32(32))
    use = letter.copy()
    use[1:] |= letter[:-1] & (rows[1:] == rows[:-1])  # the first space after a letter
    has = np.zeros(len(offsets) - 1, bool)
    has[rows[letter]] = True
    points, rows = points[use], rows[use]
    out, owner = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * _FACTORS[k]
                h ^= h >> np.uint32(15)
            inside = rows[: len(h)] == rows[n - 1 :]
            out.append((h[inside] & np.uint32(DIMS - 1)).astype(np.int64))
            owner.append(rows[: len(h)][inside])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(out), np.concatenate(owner), has


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts, very long ones cut between code points, as (first row, bytes, offsets)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[end])
        if b - a <= 2 * CHUNK or end > row + 1:
            yield row, data[a:b], offsets[row : end + 1] - a
        else:
            while a < b:
                cut = min(b, a + CHUNK)
                while cut < b and (data[cut] & 0xC0) == 0x80:
                    cut += 1
                yield row, data[a:cut], np.array([0, cut - a])
                a = cut
        row = end


def train(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages, and how often each has each n-gram (``lang, gram, n``), from all rows of ``text, lang``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in text_slices(batches):
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                seen.setdefault(lang, np.zeros(DIMS, np.int64))
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            for row, data, offsets in _pieces(*text_buffers(batch.column("text"))):
                gram, owner, _ = grams(data, offsets)
                n = np.bincount(code[owner + row] * DIMS + gram, minlength=len(names) * DIMS)
                for i, name in enumerate(names):
                    seen[name] += n[i * DIMS : (i + 1) * DIMS]
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * (len(at) + 1), pa.string()),
                    "gram": pa.array([*at.tolist(), -1], pa.int32()),
                    "n": pa.array([*n[at].tolist(), 1], pa.int64()),
                }
            )

    known = docs.where("lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = checkpoint(
        known.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    return sorted(r["lang"] for r in rows.where("gram = -1").select("lang").collect()), rows.where("gram >= 0")


def log_matrix(langs: list[str], rows: DataFrame) -> np.ndarray:
    """Log-probabilities of the n-grams (first axis) in some languages."""
    counts = np.zeros((len(langs), DIMS))
    place = {lang: i for i, lang in enumerate(langs)}
    cells = rows.where((F.col("lang") >= langs[0]) & (F.col("lang") <= langs[-1])).toArrow().to_pandas()  # at most languages times DIMS
    cells = cells[cells["lang"].isin(place)]
    if len(cells):
        counts[cells["lang"].map(place).to_numpy(int), cells["gram"].to_numpy(int)] = cells["n"].to_numpy(float)
    smooth = counts + SMOOTHING
    return np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T, np.float32)


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """``docs`` with ``lang_pred``, ``_top`` and ``_rest``, the best of these languages and those before.

    ``_top`` is the best sum of log-probabilities, ``_rest`` the sum of all likelihoods over it;
    columns of these names, from a pass over other languages, are taken up.
    """
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    made = ("lang_pred", "_top", "_rest")
    first = "_top" not in docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for batch in text_slices(batches):
            sums = np.zeros((batch.num_rows, matrix.shape[1]))
            has = np.zeros(batch.num_rows, bool)
            for row, data, offsets in _pieces(*text_buffers(batch.column("text"))):
                gram, owner, letters = grams(data, offsets)
                has[row : row + len(letters)] |= letters
                # the sparse product: how often each row has each n-gram, times the matrix
                pair, n = np.unique(owner * DIMS + gram, return_counts=True)
                own = pair // DIMS
                if len(pair):
                    begin = np.flatnonzero(np.diff(own, prepend=-1))
                    part = np.add.reduceat(matrix[pair % DIMS] * n[:, None], begin, axis=0)
                    sums[row + own[begin]] += part
            best, top = sums.argmax(1), sums.max(1)
            rest = np.where(has, np.exp(sums - top[:, None]).sum(1), np.inf)
            names = [langs[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
            if not first:
                before, total = (batch.column(c).to_numpy() for c in made[1:])
                old = batch.column("lang_pred").to_pylist()
                names = [o if keep else new for o, new, keep in zip(old, names, (before >= top).tolist(), strict=True)]
                highest = np.maximum(before, top)
                rest = total * np.exp(before - highest) + rest * np.exp(top - highest)
                top = highest
            kept = [c for c in batch.schema.names if c not in made]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(rest, pa.float64())],
                names=[*kept, *made],
            )

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in made)
    return docs.mapInArrow(score, f"{carried}, lang_pred string, _top double, _rest double")


def identify(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score``.

    ``docs`` needs ``doc_id, text, lang``; other columns are ignored. ``held_out`` rows (CRC-32
    of the id as text leaves 2 when divided by 4) and rows without a language teach nothing. A
    null text and one without letters get ``und`` and 0. ``score`` is the posterior under equal
    priors; ties go to the language first in the alphabet. If no row teaches, all is ``und``.
    A null id is not held out. Repeated rows each count and each get a row.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").withColumn(
        "held_out", held_out(F.col("doc_id"))
    )
    langs, counts = train(rows.where(~F.col("held_out")))
    out = rows.select("doc_id", "held_out", "text")
    if not langs:
        return out.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for k in range(0, len(langs), LANGUAGES_AT_ONCE):
        own = langs[k : k + LANGUAGES_AT_ONCE]
        out = predict(out, own, log_matrix(own, counts))
    return out.select("doc_id", "held_out", "lang_pred", (1 / F.col("_rest")).alias("score"))

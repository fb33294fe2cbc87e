"""Best-fit packing: documents as token sequences, placed by the sum-of-squares rule.

A piece goes into the open sequence whose use leaves the smallest sum, over residual gaps, of
the squared number of open sequences with that gap; a tie goes to the smaller gap. A new
sequence is opened only where no open one has room, and pieces come longest first. Shards of a
fixed number of pieces are packed side by side. The sequences of a shard with the largest gaps
are opened again and packed with those of other shards, in ever fewer shards, so that what
stays unfilled doesn't grow with the number of shards.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_slices

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces that one task packs, and the share of them (one in so many) that is packed again.
SHARD_PIECES = 16_384
REPACKED = 16
#: Words whose ids a Python process remembers, and the longest of them in characters.
REMEMBERED = 1_200_000
LONGEST_WORD = 64
#: Bytes of text whose words are gathered at once: the more, the fewer are met again.
SLICE = 1 << 23
#: The id that ends a document.
END = 0


class WordIds(dict):
    """The ids of words between blanks, as bytes of little-endian 32-bit numbers.

    No token of this vocabulary holds a blank, nor a letter and the stop or comma after it, so
    a text's ids are those of its words one after another. Words that weren't met before are
    encoded together, with a mark between. The tokenizer lowers A to Z itself, so they are
    lowered first where no special token can be meant. Words of small Latin letters alone stay
    as they are in all its steps before the merges, so those steps are left out for them.
    """

    MARK = "\x01"
    STOPS = ".,;:!?"

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        self.tokenizer, self.merges = Tokenizer.from_file(file), Tokenizer.from_file(file)
        self.merges.normalizer = normalizers.Sequence([])
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_of])
        self.plain = re.compile("[a-zß-öø-ÿ]+").fullmatch
        (self.mark,) = self.encode(self.MARK)
        self.letters = frozenset(chr(c) for c in range(256) if chr(c).isalnum() and (c < 128 or chr(c).isalpha()))
        self.stops = {c: self[c] for c in self.STOPS}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        return np.array(self.encode(word), "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        self[""] = b""
        stops, letters, mark, small = self.stops, self.letters, self.MARK, self.plain
        stopped, new = [], set()
        for w in words.difference(self):
            if w[-1] in stops and w[-2:-1] in letters:
                stopped.append(w)
                w = w[:-1]
            new.add(w)
        plain, other = [], []
        for w in new.difference(self):
            if len(w) <= LONGEST_WORD:
                if small(w):
                    plain.append(w)
                elif mark not in w:
                    other.append(w)
        for begin in range(0, len(plain), 1000):
            some = plain[begin : begin + 1000]
            found = self.merges.encode(" ".join(some), add_special_tokens=False)
            place = np.array(found.word_ids, np.int64)
            self._keep(some, np.array(found.ids, "<u4"), np.append(np.flatnonzero(np.diff(place)) + 1, len(place)), 0)
        for begin in range(0, len(other), 1000):
            some = other[begin : begin + 1000]
            ids = np.array(self.encode(f" {self.MARK} ".join(some)), "<u4")
            self._keep(some, ids, np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)
        for w in stopped:
            if len(w) <= LONGEST_WORD:
                self[w] = self[w[:-1]] + self.stops[w[-1]]

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray, between: int) -> None:
        """Take the ids of words that stand one after another, each up to its end and so many ids apart."""
        raw, first = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            self[word] = raw[first:end]
            first = end + 4 * between

    def of_texts(self, texts: list[str]) -> Iterator[bytes]:
        split, words = [], set()
        for text in texts:
            if "<|" not in text:
                text = text.encode().lower().decode()
            some = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            words.update(some)
            split.append(some)
        self.learn(words)
        for some in split:
            yield b"".join(itemgetter(*some)(self)) if len(some) > 1 else self[some[0]]


def _known(file: str) -> WordIds:
    """The words that earlier tasks of this Python process have met: Spark runs many in one."""
    held = sys.modules.setdefault("_memloom_words", types.ModuleType("_memloom_words")).__dict__
    if file not in held:
        held[file] = WordIds(file)
    return held[file]


def pieces(docs: DataFrame, file: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of a document: ``doc_id, piece, start, length, ids_crc32``; see ``pack``."""
    id_type = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        known = _known(file or public_tokenizers.path("word_bpe_49k.json"))
        end = np.array([END], "<u4").tobytes()
        for batch in text_slices(batches, limit=SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(known.of_texts(texts)):
                ids += end
                for k, begin in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[begin : begin + 4 * capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(begin // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long"
    )


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence and offset of each piece, and the gap left in each sequence.

    Pieces are placed longest first; those of equal length in the order given.
    """
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    for at in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[at])
        now = count[n:]  # gaps that have room, and below what they become
        then = count[: capacity + 1 - n]
        # Growth of the sum: the gap loses one sequence and the rest of it wins one; a gap that is filled only loses.
        growth = 2 * (then - now) + 2
        growth[0] = 1 - 2 * now[0]
        growth[now == 0] = np.iinfo(np.int64).max
        rest = int(growth.argmin())
        if now[rest]:
            gap = n + rest
            bin_ = waiting[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_ = capacity, len(gaps)
            gaps.append(capacity)
            rest = capacity - n
        sequence[at], offset[at], gaps[bin_] = bin_, capacity - gap, rest
        if rest:
            count[rest] += 1
            waiting[rest].append(bin_)
    return sequence, offset, np.array(gaps, np.int64)


def _repacked(sequence: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Whether each piece is packed again: those of the sequences of the largest gaps, one piece in ``REPACKED`` in all."""
    if not len(gaps):
        return np.zeros(0, bool)
    widest = np.argsort(-gaps, kind="stable")
    held = np.cumsum(np.bincount(sequence, minlength=len(gaps))[widest])
    again = np.zeros(len(gaps), bool)
    again[widest[(held <= len(sequence) // REPACKED) & (gaps[widest] > 0)]] = True
    return again[sequence]


def pack(docs: DataFrame, file: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``file`` is a tokenizer
    without tokens that hold blanks (by default the public ``word_bpe_49k.json``). A document is
    its ids and ``END``; a longer one than ``capacity`` is cut, the last piece may be shorter. A
    null or empty text is ``END`` alone. Rows that repeat an id, and rows without one, are packed
    each on its own. Pieces of equal length are taken in the order of id, piece and checksum. An
    empty table gives no rows. ``sequence_id`` names round, shard and place in the shard.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rest = saved(pieces(docs, file, capacity))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema)
    done: DataFrame | None = None
    level = 0
    while True:
        shards = max(1, -(-rest.count() // SHARD_PIECES))

        def place(batches: Iterator[pa.RecordBatch], last: bool = shards == 1, level: int = level) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
            sequence, offset, gaps = sum_of_squares(table["length"].to_numpy(), capacity)
            again = np.zeros(len(sequence), bool) if last else _repacked(sequence, gaps)
            shard = table["_shard"][0].as_py()
            out = table.drop_columns("_shard").append_column("sequence_id", pa.array(sequence + (level << 56 | shard << 24)))
            out = out.append_column("offset", pa.array(offset)).append_column("_again", pa.array(again))
            yield from out.to_batches(max_chunksize=10_000)

        # Dealt out evenly, not by a key, so that no shard is larger than the others.
        packed = saved(
            rest.repartition(shards)
            .withColumn("_shard", F.spark_partition_id())
            .mapInArrow(place, f"{schema}, sequence_id long, offset long, _again boolean")
        )
        closed = packed.where(~F.col("_again")).select(*names, "sequence_id", "offset")
        done = closed if done is None else done.unionByName(closed)
        if shards == 1:
            return done
        rest = packed.where("_again").select(*names)
        level += 1

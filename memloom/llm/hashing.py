"""Words and word hashes of many texts at once, in numpy.

A word is a run of bytes other than space and tab to carriage return. Its 64-bit hash is
multilinear (a random number for each byte value times one for each place), then mixed.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240201))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters and the bytes of other letters, for words without punctuation.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = NOT_LETTERS[128:] = False
#: Everything but those and digits.
NOT_ALPHANUMERIC = NOT_LETTERS.copy()
NOT_ALPHANUMERIC[48:58] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the row it stands in."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = offsets[:-1][np.diff(offsets) > 0]
    first[opens] = inside[opens]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    closes = offsets[1:][np.diff(offsets) > 0] - 1
    last[closes] = inside[closes]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def _places(at: np.ndarray) -> np.ndarray:
    """A random odd number for each place; beyond the table it is drawn anew for each round of it."""
    out = _PLACE[at & 4095]
    far = at > 4095
    if far.any():
        out[far] = mix(out[far] + (at[far] >> 12).astype(np.uint64)) | np.uint64(1)
    return out


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False
) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased first if asked."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = np.cumsum(lengths)
    begin = total - lengths
    at = np.arange(total[-1]) - np.repeat(begin, lengths)
    spelled = data[at + np.repeat(starts, lengths)]
    if lower:
        spelled = _LOWER[spelled]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[spelled] * _places(at), begin)
        return mix(sums + lengths.astype(np.uint64))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words (of ``words`` as one sequence)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out += words[k : k + n] * _STEP[k]
    return mix(out)


def sequence_hash(words: np.ndarray) -> int:
    """A hash of a whole sequence of words, of any length."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([(words * _places(np.arange(len(words)))).sum() + np.uint64(len(words))], np.uint64))[0])

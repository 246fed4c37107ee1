"""Hashes of words and of runs of words, for many texts at once.

A word is a run of bytes that aren't ASCII blanks.
"""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_BYTE[_BLANK] = 0
ODD = _rng.integers(0, 2**63, 3, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrases(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hash of each phrase of so many words."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(base, n), dtype=np.uint64)))
    return mix((sums[length:] - sums[:-length]) * _powers(inverse, n - length + 1))



def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts laid end to end, and the number of words before each text (and of all)."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    offsets = np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths))))
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    spread = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spread)
    # blanks after a word count nothing, wherever they are
    np.minimum(place, int(np.diff(np.flatnonzero(np.concatenate(([True], blank)))).max()), out=place)
    values = _BYTE[data[starts[0] :]] * _powers(ODD[0], int(place.max()) + 1)[place]
    return mix(np.add.reduceat(values, starts - starts[0])), offsets

"""64-bit hashes of words and windows of byte arrays, computed for a whole batch at once.

A prefix sum of ``table[byte] * B**position`` (modulo 2**64, B odd) gives the hash of any stretch of bytes as the
difference of two sums, moved to position 0 by the inverse power. Equal bytes have equal hashes at any place.
Such sums are for windows of one length of a few hundred values at most: longer stretches can be made to collide for every
base (Thue-Morse strings do from 1,024 on). Words and other stretches of any length go through xxh3.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count - 1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        known = np.empty(max(count, 1 << 20), np.uint64)
        known[0] = 1
        known[1:] = np.uint64(base)
        _powers[base] = known = np.cumprod(known, dtype=np.uint64)
    return known[:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Stretches:
    """Hashes of stretches of one array: of bytes, or of hashes of words."""

    def __init__(self, values: np.ndarray):
        values = _TABLE[values] if values.dtype == np.uint8 else mixed(values)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(_BASE, len(values)), dtype=np.uint64, out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the stretches ``starts:ends``; their lengths count as well."""
        moved = (self.sums[ends] - self.sums[starts]) * powers(_INVERSE, len(self.sums))[starts]
        return mixed(moved + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``starts:ends``, which do not overlap; each different word is hashed once."""
    marks = np.zeros(len(data) + 1, np.int8)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    said = np.ascontiguousarray(data[np.cumsum(marks[:-1], dtype=np.int8) == 1])
    place = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(said)]).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, texts.dictionary.to_pylist()), np.uint64, len(texts.dictionary))
    return known[texts.indices.to_numpy(zero_copy_only=False)]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no white space, and the text each lies in."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # where a run cannot go on from the byte before
    edge[offsets] = True
    begins = solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]]))
    stops = solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1

"""Maximal repetitions of words by a dictionary of basic factors.

Every word position of a text gets, for each length of 1, 2, 4, .. words, a number that equal stretches of that length
share (the pair of numbers of its two halves, numbered anew). Where the next occurrence of a position's stretch of length L
lies at a distance d, at most twice L, the two propose the period d; positions in a row with one distance form an arithmetic
progression. For a period q and the L with L/2 < q <= L the nearest occurrence inside a run of period q lies exactly q
onward (a nearer one would make the run's period smaller, by the theorem of Fine and Wilf), so a run is such a row of
positions; periods up to twice L come again, exact, at the next length. Proposals are extended to both sides word by word
and deduplicated.

A run has the smallest period q and at least ``max(least, power * q)`` words; collapsing keeps its first q words.

Stretches that occur once in a text are left out before the next length, so the work follows what repeats. Everything stays
inside a text: no shuffle, memory bounded by a batch and its longest text.

Defined cases: a null or empty text and one without words has no runs. Rows that repeat are treated each. Other columns are
kept; columns of the added names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import added, bounded, text_bytes, with_added
from .hashing import words

LEAST, POWER = 6, 4


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, a number for each different word, and the n + 1 offsets of the texts among them."""
    starts, ends, of = words(data, offsets)
    edges = np.zeros(len(data) + 1, np.int8)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    solid = np.ascontiguousarray(data[np.cumsum(edges[:-1], dtype=np.int8) == 1])
    sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(solid)])
    numbered = texts.dictionary_encode()
    return texts, numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(of, np.arange(len(offsets)))


def _repeated(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal numbers side by side, by place, and where one equals the one before it."""
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    return order, np.concatenate([[False], ranked[1:] == ranked[:-1]]) if len(ranked) else np.zeros(0, bool)


def runs(code: np.ndarray, begin: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of all texts, by start and period; starts count through all texts."""
    count = len(code)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    stop = begin[1:][text] if count else np.zeros(0, np.int64)
    longest = int(np.diff(begin).max(initial=0))
    at, rank = np.arange(count), code + text * (code.max(initial=0) + 1)
    found = []
    size = 1
    while len(at) and size // 2 * power < longest:  # a period over size / 2 must fit its power
        order, same = _repeated(rank)
        here = at[order]
        twin = np.flatnonzero(same)
        first, step = here[twin - 1], here[twin] - here[twin - 1]
        near = step <= 2 * size
        first, step = first[near], step[near]
        row = np.argsort(first)
        first, step = first[row], step[row]
        fresh = np.concatenate([[True], (first[1:] != first[:-1] + 1) | (step[1:] != step[:-1])]) if len(first) else np.zeros(0, bool)
        heads = np.flatnonzero(fresh)
        many = np.diff(np.append(heads, len(first)))
        head, period = first[heads], step[heads]
        found.append(np.stack([head, head + many - 1 + size + period, period]))
        # The next length: both halves must repeat.
        again = same | np.concatenate([same[1:], [False]])
        named = np.full(count, -1, np.int64)
        named[here[again]] = np.cumsum(~same)[again]
        at = np.flatnonzero(named >= 0)
        at = at[at + 2 * size <= stop[at]]
        at = at[named[at + size] >= 0]
        rank = named[at] * (count + 1) + named[at + size]
        size *= 2
    start, end, period = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    long = end - start >= np.maximum(least, power * period)
    start, end, period = start[long], end[long], period[long]
    start, end = _extended(code, begin, text, start, end, period)
    start, period, end = np.unique(np.stack([start, period, end]), axis=1)
    return start, end - start, period


def _extended(code, begin, text, start, end, period) -> tuple[np.ndarray, np.ndarray]:
    """Runs made as long as their period holds."""
    start, end = start.copy(), end.copy()
    low, high = begin[text[start]], begin[text[start] + 1]
    moving = np.arange(len(start))
    while len(moving):
        moving = moving[start[moving] > low[moving]]
        moving = moving[code[start[moving] - 1] == code[start[moving] - 1 + period[moving]]]
        start[moving] -= 1
    moving = np.arange(len(start))
    while len(moving):
        moving = moving[end[moving] < high[moving]]
        moving = moving[code[end[moving]] == code[end[moving] - period[moving]]]
        end[moving] += 1
    return start, end


def dropped(count: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words a run contains after its first period."""
    edges = np.zeros(count + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:-1]) > 0


_RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


def periodic_runs(docs: DataFrame, text: str = "text", planted: str | None = None, least: int = LEAST, power: int = POWER) -> DataFrame:
    """Add ``runs`` (start, length, period; by start and period) and ``collapsed``, the words kept, joined by one space.

    ``planted`` names a column of numbers g that plant a known repetition: in a text of n words every word i from a = g % n on
    becomes the word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Null leaves the words as they are. ``power`` is 3 or more.
    """
    wanted = added(docs, runs=T.ArrayType(_RUN), collapsed=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text):
            texts, code, begin = codes(*text_bytes(batch.column(text)))
            source = np.arange(len(code))
            if planted is not None:
                for i, g in enumerate(batch.column(planted).to_pylist()):
                    if g is not None and begin[i + 1] > begin[i]:
                        head = begin[i] + g % (begin[i + 1] - begin[i])
                        rest = begin[i + 1] - head
                        source[head : begin[i + 1]] = head + np.arange(rest) % (1 + rest // (3 + g % 8))
                code = code[source]
            start, length, period = runs(code, begin, least, power)
            kept = np.flatnonzero(~dropped(len(code), start, length, period))
            of = np.searchsorted(begin, start, "right") - 1
            parts = [start - begin[of], length, period]
            shape = pa.array(np.searchsorted(start, begin).astype(np.int32))
            held = pa.ListArray.from_arrays(shape, pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], names=_RUN.names))
            said = texts.take(pa.array(source[kept])).to_pylist()
            cuts = np.searchsorted(kept, begin)
            joined = [b" ".join(said[a:b]).decode() for a, b in zip(cuts, cuts[1:])]
            yield with_added(batch, {"runs": held, "collapsed": pa.array(joined, pa.string())}).select(wanted.names)

    return docs.mapInArrow(run, wanted)

"""Byte-level BPE by dynamic programming over prefixes.

Every byte prefix of a piece has exactly one valid last token: the token ``t`` that ends there and is *compatible*
with the last token of the prefix before it, that is, merging the bytes of the two gives back the two. So one array,
the last token of each prefix, holds the encodings of all prefixes. Appending bytes extends the array and never
changes what is there; truncating cuts it; an edit inside keeps the part before it.

A text is first split into pieces by a pattern; pieces are encoded separately. The pattern looks ahead by at most two
characters and never back, so after an edit only pieces near it are split and encoded again (:class:`Encoded`).

Defined cases: a null or empty text has no tokens and decodes to no bytes. A text without any match of the pattern
cannot occur, as the pattern covers all characters. Repeated rows stay rows; other columns are kept, except those
named like the added ones, which are replaced. Null ids decode to no bytes; an id outside the vocabulary raises.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import added, bounded, with_added

#: Entries in each generation of what a worker remembers.
MEMORY = 120_000
#: Bytes encoded and ids decoded at a time.
BATCH_TEXT, BATCH_IDS = 1 << 20, 1 << 19
#: Bytes of pieces whose prefixes are remembered across pieces.
SHORT = 64
#: Pieces that text after them can still change: "'l" are two until a further "l" makes "'ll".
UNSETTLED = 2


class Recent(dict):
    """Results of ``make`` by argument. When it is full, results not asked for since it was last full are let go."""

    def __init__(self, make: Callable, size: int = MEMORY):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        found = self.older.get(key)
        return self.put(key, self.make(key) if found is None else found)

    def put(self, key, value):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Ranks of byte strings, as in a rank file (base64 and rank on each line)."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.fits = Recent(self._fits)  # by pairs of tokens
        self._halves: dict[bytes, tuple[bytes, ...]] = {}
        self._ending = {}  # longest token that ends with two given bytes
        for token in self.ranks:
            tail = token[-2:]
            self._ending[tail] = max(self._ending.get(tail, 1), len(token))
        self.last = Recent(self._last)  # by short prefixes

    def merge(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """The plain rule, for short strings: join the neighbours of lowest rank until ``down_to`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, ...]:
        """The two parts that merging joins last to make ``token``; more if merging does not make it."""
        if token not in self._halves:
            self._halves[token] = tuple(self.merge(token, 2))
        return self._halves[token]

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that lie at one end of ``token`` (side -1: right, 0: left) while it is made, and the rank that ends each."""
        found, until = [], 1 << 60
        while True:
            found.append((token, until))
            if len(token) == 1:
                return found
            until, token = self.ranks[token], self.halves(token)[side]

    def whole(self, token: int) -> bool:
        """Whether merging gives the token itself."""
        return len(self.merge(self.tokens[token])) == 1

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the second token can follow the first: no merge across their border comes before those that make the two.

        Equal ranks are merged from the left: parts of the first go before the border, parts of the second after it.
        """
        ends, starts = self.edge(self.tokens[pair[0]], -1), self.edge(self.tokens[pair[1]], 0)
        return not any(
            rank < gone_left and rank <= gone_right
            for a, gone_left in ends
            for b, gone_right in starts
            if (rank := self.ranks.get(a + b)) is not None
        )

    def candidates(self, data: bytes, end: int) -> Iterator[tuple[int, int]]:
        """Starts and ranks of the tokens that end at ``end``, longest first."""
        longest = self._ending.get(data[max(0, end - 2) : end], 1)
        for start in range(max(0, end - longest), end):
            token = self.ranks.get(data[start:end])
            if token is not None:
                yield start, token

    def _last(self, prefix: bytes) -> int:
        for start, token in self.candidates(prefix, len(prefix)):
            if self.fits[self.last[prefix[:start]], token] if start else self.whole(token):
                return token
        raise ValueError("the vocabulary has no valid last token for a prefix")

    def short(self, data: bytes) -> list[int]:
        """Tokens of a short piece, from the last tokens of those prefixes that the way back needs."""
        found = []
        while data:
            found.append(self.last[data])
            data = data[: -len(self.tokens[found[-1]])]
        return found[::-1]


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, last = self.vocabulary, self.last
        data = self.data = self.data + more
        for end in range(len(last) + 1, len(data) + 1):
            for start, token in v.candidates(data, end):
                if v.fits[last[start - 1], token] if start else v.whole(token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary has no valid last token for a prefix")

    def truncate(self, length: int) -> None:
        self.data = self.data[:length]
        del self.last[length:]

    def tokens(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[found[-1]])
        return found[::-1]


class Encoder:
    """Splits texts by a pattern and encodes the pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pieces = vocabulary, regex.compile(pattern).findall
        self.tokens = Recent(self._piece)

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode()
        token = self.vocabulary.ranks.get(data)
        if token is not None:
            return [token]
        return self.vocabulary.short(data) if len(data) <= SHORT else Prefixes(self.vocabulary, data).tokens()

    def text(self, text: str | None) -> list[int]:
        tokens = self.tokens
        return list(chain.from_iterable([tokens[p] for p in self.pieces(text)])) if text else []


class Encoded:
    """A text with its pieces and their tokens, kept exact under appends and edits."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.pieces = encoder, encoder.pieces(text)
        self.ids = [encoder.tokens[p] for p in self.pieces]

    def text(self) -> str:
        return "".join(self.pieces)

    def tokens(self) -> list[int]:
        return [t for ids in self.ids for t in ids]

    def append(self, more: str) -> None:
        end = sum(map(len, self.pieces))
        self.replace(end, end, more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace the characters ``start:end`` by ``new``; only pieces near them are made again."""
        first, offset = 0, 0
        while first < len(self.pieces) and offset + len(self.pieces[first]) <= start:
            offset += len(self.pieces[first])
            first += 1
        back = min(first, UNSETTLED)
        first, offset = first - back, offset - sum(map(len, self.pieces[first - back : first]))
        last, stop = first, offset
        while last < len(self.pieces) and stop < end:
            stop += len(self.pieces[last])
            last += 1
        span = "".join(self.pieces[first:last])
        span = span[: start - offset] + new + span[end - offset :]
        while True:  # take in pieces behind the edit until the split ends where an old piece ends
            ahead = "".join(self.pieces[last : last + UNSETTLED + 1])
            made, at = [], 0
            for piece in self.encoder.pieces(span + ahead):
                if at >= len(span):
                    break
                made.append(piece)
                at += len(piece)
            if at == len(span):
                break
            span += self.pieces[last]
            last += 1
        self.pieces[first:last] = made
        self.ids[first:last] = [self.encoder.tokens[p] for p in made]


@lru_cache(maxsize=4)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(Vocabulary(rank_file), pattern)


@lru_cache(maxsize=4)
def _spelling(rank_file: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, and by id where each begins and how long it is (-1: no such token)."""
    tokens = Vocabulary(rank_file).tokens
    length = np.full(max(tokens) + 1, -1)
    length[list(tokens)] = [len(t) for t in tokens.values()]
    begin = np.zeros(len(length), np.int64)
    begin[list(tokens)] = np.cumsum([0, *map(len, tokens.values())])[:-1]
    return np.frombuffer(b"".join(tokens.values()), np.uint8), begin, length


def _shared(df: DataFrame, path: str) -> Callable[[], bytes]:
    """The rank file, sent to the executors once; its size is that of the vocabulary."""
    with open(path, "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())
    return lambda: sent.value


Batches = Iterator[pa.RecordBatch]


def _encoder_of(rank_file: Callable[[], bytes], pattern: str, text: str, ids: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        encoder = _encoder(rank_file(), pattern)
        for batch in bounded(batches, text, BATCH_TEXT):
            found = [encoder.text(x) for x in batch.column(text).to_pylist()]
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(found), np.int32, count=int(offsets[-1]))
            yield with_added(batch, {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return run


def _decoder_of(rank_file: Callable[[], bytes], ids: str, data: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        spelled, begin, length = _spelling(rank_file())
        for batch in bounded(batches, ids, BATCH_IDS):
            column = batch.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(length) or length[flat].min() < 0):
                raise ValueError("an id is not in the vocabulary")
            ends = np.cumsum(length[flat])
            index = np.repeat(begin[flat] - ends + length[flat], length[flat]) + np.arange(ends[-1] if len(ends) else 0)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
            buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(spelled[index])]
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), buffers)
            yield with_added(batch, {data: found.cast(pa.binary())})

    return run


_IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of every whole text. ``path``: the rank file, read by the driver."""
    return df.mapInArrow(_encoder_of(_shared(df, path), pattern, text, ids), added(df, **{ids: _IDS}))


def decode(df: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for."""
    return df.mapInArrow(_decoder_of(_shared(df, path), ids, data), added(df, **{data: T.BinaryType()}))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", data: str = "decoded") -> DataFrame:
    """:func:`encode`, then :func:`decode` of the ids, in one pass."""
    rank_file = _shared(df, path)
    encoder, decoder = _encoder_of(rank_file, pattern, text, ids), _decoder_of(rank_file, ids, data)
    return df.mapInArrow(lambda batches: decoder(encoder(batches)), added(df, **{ids: _IDS, data: T.BinaryType()}))

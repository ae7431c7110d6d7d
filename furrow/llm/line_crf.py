"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are rates of its characters by kind, its length, the length of its words and
the shares of words seen before in the text and of words that repeat the word before, together with the means of the same features over the neighbouring lines.
Forward and backward passes give each line's marginal probability of being bad; weighted by line length they make the
bad share of the document, and a logistic curve turns that share into a score.

The field is fitted on labelled documents only: each line of a document takes the document's label. The fit uses a
bounded sample, at most ``fit_docs`` documents a label and ``fit_lines`` lines in all, chosen by a hash of the id;
scoring reads every whole text.

Defined cases: a null or empty text is one empty line. Null ids are scored like others. Labels that are null are not
learned from; of repeated labels of an id the mean counts. Without labels of both kinds every score is 0.5. Ties cannot
occur, and repeated rows stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import added, bounded, text_bytes, with_added
from .hashing import Stretches, words

# Kinds of bytes: each ASCII mark is a kind of its own.
_KIND = np.full(256, 4)
_KIND[:32], _KIND[32] = 0, 1
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 2, 3, 5
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_KIND[_MARKS] = 6 + np.arange(len(_MARKS))
_KINDS = 6 + len(_MARKS)
WIDTH = _KINDS + 5
_LARGEST = 30.0
#: Bytes of texts whose lines are measured at a time.
MEASURED = 1 << 18


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of a batch, and for each text the number of its first line (n + 1 entries).

    A line ends with its line feed or with its text; an empty text has one empty line.
    """
    feeds = np.flatnonzero(data == 10) + 1
    starts = np.concatenate([offsets[:-1], feeds])
    of = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds - 1, "right") - 1])
    order = np.lexsort((starts, of))
    starts, of = starts[order], of[order]
    return np.append(starts, len(data)), np.searchsorted(of, np.arange(len(offsets)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line its own features and the means of its neighbours'; the lines' lengths; first lines of the texts."""
    bounds, first = lines(data, offsets)
    count, lengths = len(bounds) - 1, np.diff(bounds)
    line_of = np.repeat(np.arange(count), lengths)
    own = np.zeros((count, WIDTH))
    kinds = np.bincount(line_of * _KINDS + _KIND[data], minlength=count * _KINDS).reshape(count, _KINDS)
    own[:, :_KINDS] = np.sqrt(kinds / np.maximum(lengths, 1)[:, None])
    starts, ends, text_of = words(data, offsets)
    if len(starts):
        in_line = line_of[starts]
        number = np.bincount(in_line, minlength=count)
        own[:, _KINDS] = np.bincount(in_line, ends - starts, count) / np.maximum(number, 1)
        hashes = Stretches(data).hash(starts, ends) ^ (text_of.astype(np.uint64) << np.uint64(40))
        _, seen_first = np.unique(hashes, return_index=True)
        again = np.ones(len(starts), bool)
        again[seen_first] = False
        same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        own[:, _KINDS + 1] = np.bincount(in_line[again], minlength=count) / np.maximum(number, 1)
        own[:, _KINDS + 4] = np.bincount(in_line[same], minlength=count) / np.maximum(number, 1)
    own[:, _KINDS + 2] = np.log1p(lengths)
    own[:, _KINDS + 3] = lengths == 0
    inner = np.ones(count + 1, bool)
    inner[first] = False  # borders between lines of one text
    near, known = np.zeros_like(own), np.zeros(count)
    has_before, has_after = inner[:-1], inner[1:]
    near[has_before] += own[np.flatnonzero(has_before) - 1]
    near[has_after] += own[np.flatnonzero(has_after) + 1]
    known += has_before.astype(float) + has_after
    near /= np.maximum(known, 1)[:, None]
    return np.hstack([own, near]), lengths, first


@dataclass(frozen=True)
class Field:
    """Weights of the fitted field and of the curve over the bad share."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the state "bad", bias last
    change: np.ndarray  # 2 x 2, from state to state
    curve: tuple[float, float] = (0.0, 0.0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def energy(self, scaled: np.ndarray) -> np.ndarray:
        return np.clip(scaled @ self.weights[:-1] + self.weights[-1], -_LARGEST, _LARGEST)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, lengths, first = features(data, offsets)
        bad, _ = marginals(self.energy(self.scaled(x)), np.exp(self.change), first)
        share = bad_share(bad, lengths, first)
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * share)))


def marginals(energy: np.ndarray, change: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of "bad" for every line, and the expected number of each change of state.

    All texts of the batch are passed at once, line by line; longer ones stay in play longer.
    """
    count, sizes = len(energy), np.diff(first)
    emit = np.stack([np.exp(np.minimum(0, -energy)), np.exp(np.minimum(0, energy))], 1)
    forward, backward = np.empty((count, 2)), np.ones((count, 2))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more lines than t
    for t in range(longest):
        at = starts[: active[t]] + t
        here = emit[at] if t == 0 else emit[at] * (forward[at - 1] @ change)
        forward[at] = here / here.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        here = (emit[at + 1] * backward[at + 1]) @ change.T
        backward[at] = here / here.sum(1, keepdims=True)
    both = forward * backward
    inner = np.ones(count, bool)
    inner[starts[sizes > 0]] = False
    to = np.flatnonzero(inner)
    pairs = forward[to - 1][:, :, None] * change[None] * (emit[to] * backward[to])[:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    return both[:, 1] / both.sum(1), pairs.sum(0)


def bad_share(bad: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the marginals of each text's lines, weighted by their lengths."""
    weight = np.maximum(lengths, 1)
    return np.add.reduceat(bad * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def fit(x: np.ndarray, lengths: np.ndarray, first: np.ndarray, good: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; ``good`` holds the label of each text."""
    spread = x.std(0)
    field = Field(x.mean(0), np.where(spread > 1e-6, spread, 1.0), np.zeros(x.shape[1] + 1), np.zeros((2, 2)))
    z = np.hstack([field.scaled(x), np.ones((len(x), 1))])
    bad = np.repeat(~good, np.diff(first)).astype(float)
    stays = np.maximum(np.diff(first) - 1, 0)
    observed = np.diag([stays[good].sum(), stays[~good].sum()]).astype(float)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        change = theta[-4:].reshape(2, 2)
        energy = np.clip(z @ theta[:-4], -_LARGEST, _LARGEST)
        guess, moved = marginals(energy, np.exp(change), first)
        slope = np.concatenate([z.T @ (bad - guess), (observed - moved).ravel()]) / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -3, 3)
    field = Field(field.mean, field.spread, theta[:-4], theta[-4:].reshape(2, 2))
    guess, _ = marginals(field.energy(z[:, :-1]), np.exp(field.change), first)
    return Field(field.mean, field.spread, field.weights, field.change, _curve(bad_share(guess, lengths, first), good))


def _curve(share: np.ndarray, good: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic regression of the label on the bad share, by Newton steps; the slope is never positive."""
    design, theta = np.stack([np.ones_like(share), share], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (good - p) - ridge * theta
        theta += np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), slope)
    return float(theta[0]), float(min(theta[1], 0.0))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = 2000, fit_lines: int = 150_000,
    doc_id: str = "doc_id", text: str = "text",
) -> Field | None:
    """Fit on at most ``fit_docs`` documents of each label, the first by a hash of the id.

    ``labels`` holds only rows that may be learned from. The sample, not the corpus, comes to the driver: numbers
    per line, at most ``fit_lines`` lines. None if a label is missing.
    """
    marks = labels.groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).alias("_good")).where("_good is not null")
    lot = F.xxhash64("_id")
    chosen = marks.where("_good").orderBy(lot, "_id").limit(fit_docs).union(
        marks.where("not _good").orderBy(lot, "_id").limit(fit_docs)
    )
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_text", MEASURED):
            x, lengths, first = features(*text_bytes(batch.column("_text")))
            parts = [(x[a:b].astype("f4").tobytes(), lengths[a:b].astype("i8").tobytes()) for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_good"), *(pa.array(c, pa.binary()) for c in zip(*parts))],
                names=["_id", "_good", "x", "lengths"],
            )

    kind = f"_id {chosen.schema['_id'].dataType.simpleString()}, _good boolean, x binary, lengths binary"
    shares, sizes, good, total = [], [], [], 0
    for row in sample.mapInArrow(measure, kind).orderBy(F.xxhash64("_id"), "_id").toLocalIterator():
        found = np.frombuffer(row.lengths, "i8")
        if total + len(found) > fit_lines:
            continue
        total += len(found)
        sizes.append(found)
        shares.append(np.frombuffer(row.x, "f4").reshape(len(found), -1))
        good.append(row._good)
    good = np.array(good, bool)
    if not good.any() or good.all():
        return None
    first = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    return fit(np.concatenate(shares).astype(float), np.concatenate(sizes), first, good)


def score(docs: DataFrame, field: Field | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add each whole text's score: near 1 for good texts, near 0 for bad ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text, MEASURED):
            data, offsets = text_bytes(batch.column(text))
            found = field.score(data, offsets) if field else np.full(batch.num_rows, 0.5)
            yield with_added(batch, {out: pa.array(found, pa.float64())})

    return docs.mapInArrow(run, added(docs, **{out: T.DoubleType()}))

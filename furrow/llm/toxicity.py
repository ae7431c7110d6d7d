"""Toxicity by a weighted lexicon.

A text is folded first: compatibility forms and lower case, letters of other scripts that look Latin, digits and signs
that stand for letters (``1d10t``, ``$tupid``), then everything but letters and digits becomes one space. The lexicon
holds whole words, stems that a word may begin with, and exception phrases; an Aho-Corasick automaton finds all of them
in one pass over the folded text. Of the entries that begin at one word the longest counts, and none inside an exception
phrase. The weights of what counts are summed and normalised by the number of words; a logistic curve over the sum and
its density gives the score.

Weights are learned: of labelled documents (at most ``fit_docs`` of each label) the words and stems that lie in more toxic
documents than chance allows (a likelihood ratio test) enter with their logarithmic odds. A stem enters when at least
``STEM_WORDS`` different words of toxic documents begin with it. A few common insults are entries from the start. Phrases
of an entry and its neighbour that only clean documents use become exceptions. Counts are taken on Spark; the lexicon (at
most ``entries`` rows of each kind) and two numbers for each document of the sample come to the driver.

Defined cases: a null or empty text and one without words has no hits and scores as any text without hits. Without
documents of both labels the start lexicon and a fixed curve are used. Rows that repeat an id are scored each; labels that
disagree count by their mean, null labels not at all. Other columns are kept; a column of the added name is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut, discard
from .arrow import added, bounded, with_added

#: Entries of the start lexicon, their weight, and exceptions for them.
START_WORDS = (
    "idiot idiots stupid moron morons imbecile loser losers scum trash pathetic worthless disgusting clown dumbass retard "
    "bastard bitch asshole idiota imbecil estupido estupida imbécile connard abruti salaud dummkopf arschloch schwachkopf"
).split()
START_WEIGHT = 4.0
START_EXCEPTIONS = ["trash can", "trash bin", "trash bag", "clown fish", "circus clown", "pond scum", "sore loser"]
#: Letters of other scripts, and the Latin ones they look like.
_LIKE = {
    "a": "аα", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡց", "h": "һнհ", "i": "іιıɩ", "j": "јϳ", "k": "кκ", "l": "ӏℓ",
    "m": "м", "n": "ηո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "у",
}
LOOKALIKES = {ord(other): letter for letter, others in _LIKE.items() for other in others}
#: Signs and digits, and the letters they stand for.
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
_FRONT = re.compile(r"[0134578@$!|]+(?=[^\W\d_])")  # directly before a letter
_TAIL = re.compile(r"(?<=[^\W\d_])[0134578]{1,2}(?!\w)")  # at the end of a word
_GAP = re.compile(r"[\W_]+")

WEIGHT = 2.0  # least logarithmic odds of a learned entry
CHANCE = 15.0  # least likelihood ratio statistic
SHARE = 0.01  # of the toxic documents that an entry must lie in, three at least
STEM, STEM_WORDS, LONGEST = (4, 10), 3, 40


def fold(text: str | None) -> str:
    """The folded text: words parted by one space each, one before the first and after the last."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(LOOKALIKES)
    else:
        text = text.lower()
    text = _FRONT.sub(lambda m: m[0].translate(SIGNS), text)
    text = _TAIL.sub(lambda m: m[0].translate(SIGNS), text)
    text = _GAP.sub(" ", text).strip()
    return f" {text} " if text else " "


@dataclass
class Lexicon:
    """Entries are folded words in spaces, or stems after one; exceptions are phrases in spaces."""

    weights: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found


def hits(automaton: ahocorasick.Automaton, folded: str) -> dict[int, tuple[int, float]]:
    """For each word that an entry begins at (the place of the space before it): length and weight of the longest one."""
    best: dict[int, tuple[int, float]] = {}
    holes = []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            holes.append((start, end))
        elif start not in best or best[start][0] < length:
            best[start] = (length, weight)
    for start, end in holes:
        while 0 <= start < end:
            best.pop(start, None)
            start = folded.find(" ", start + 1)
    return best


def measured(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, int]:
    """Summed weights and number of words of a text."""
    folded = fold(text)
    return sum(weight for _, weight in hits(automaton, folded).values()), folded.count(" ") - 1


def _design(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(1000 * total / (words + 20))], 1)


def start() -> Lexicon:
    """The lexicon of before any label is seen."""
    return Lexicon({f" {w} ": START_WEIGHT for w in START_WORDS}, [f" {p} " for p in START_EXCEPTIONS], (-5.0, 1.3, 0.8))


def _told(pairs: Iterator[tuple[str, bool]]) -> pa.RecordBatch:
    names, toxic = zip(*pairs) if (pairs := list(pairs)) else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.bool_())], names=["entry", "toxic"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and stems of each document, each once."""
    for batch in bounded(batches, "text"):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = {w for w in fold(text).split() if len(w) <= LONGEST}
            stems = {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w)) + 1)}
            yield _told((e, toxic) for e in [*(f" {w} " for w in words), *(f" {s}" for s in stems)])


def _tested(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Entries (entry, weight, g) that lie in more toxic documents than chance allows."""
    a, b = F.col("a"), F.col("b")
    share = (a + b) / F.lit(float(toxic + clean))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (
        part(a, toxic * share) + part(b, clean * share) + part(toxic - a, toxic * (1 - share)) + part(clean - b, clean * (1 - share))
    )
    weight = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    found = counts.where(a >= max(3, SHARE * toxic)).select("entry", weight.alias("weight"), g.alias("g"))
    return found.where((F.col("weight") >= WEIGHT) & (F.col("g") >= CHANCE))


def _learned(sample: DataFrame, toxic: int, clean: int, entries: int) -> dict[str, float]:
    seen = sample.mapInArrow(_entries, "entry string, toxic boolean").groupBy("entry")
    counts = cut(seen.agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")))
    words = counts.where("a > 0 and endswith(entry, ' ')")
    size = F.least(F.lit(STEM[1]), F.char_length("entry") - 2)
    heads = words.where(size >= STEM[0]).select(F.explode(F.sequence(F.lit(STEM[0]), size)).alias("size"), F.col("entry").alias("word"))
    wide = heads.groupBy(F.expr("substring(word, 1, size + 1)").alias("entry")).agg(F.count("*").alias("many")).where(f"many >= {STEM_WORDS}")
    stems = counts.where("not endswith(entry, ' ')").join(wide.select("entry"), "entry", "left_semi")
    tested = _tested(counts.where("endswith(entry, ' ')").unionByName(stems), toxic, clean)
    rows = tested.orderBy(F.col("g").desc(), "entry").limit(entries).collect()
    discard(counts)
    return {r.entry: r.weight for r in rows}


def _excepted(sample: DataFrame, lexicon: Lexicon, entries: int, least: int = 3) -> list[str]:
    """Two-word phrases around hits that at least ``least`` documents use, all of them clean."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in bounded(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                folded, phrases = fold(text), set()
                for at in hits(automaton, folded):
                    end = folded.find(" ", at + 1)
                    before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
                    phrases |= {folded[before : end + 1] if before >= 0 else "", folded[at : after + 1] if after >= 0 else ""}
                yield _told((p, toxic) for p in phrases if p)

    told = sample.mapInArrow(run, "entry string, toxic boolean").groupBy("entry").agg(F.count("*").alias("n"), F.max("toxic").alias("toxic"))
    rows = told.where(f"not toxic and n >= {least}").orderBy(F.col("n").desc(), "entry").limit(entries).collect()
    return [r.entry for r in rows]


def _curve(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    theta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (toxic - p)) - ridge * theta
        theta += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(theta)), slope)
    return tuple(float(t) for t in theta)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_docs: int = 3000, entries: int = 20_000,
    doc_id: str = "doc_id", text: str = "text",
) -> Lexicon:
    """Fit on at most ``fit_docs`` documents of each label, the first by a hash of the id. ``labels``: rows to learn from."""
    marks = labels.groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).alias("toxic")).where("toxic is not null and _id is not null")
    of_all = dict(marks.groupBy("toxic").count().collect())
    lot = F.xxhash64("_id")
    chosen = marks.where("toxic").orderBy(lot, "_id").limit(fit_docs).union(marks.where("not toxic").orderBy(lot, "_id").limit(fit_docs))
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    sample = cut(found.join(F.broadcast(chosen), "_id"))  # at most 2 * fit_docs rows are broadcast
    held = dict(sample.groupBy("toxic").count().collect())
    lexicon = start()
    if len(held) == 2:
        lexicon.weights |= _learned(sample, held[True], held[False], entries)
        lexicon.exceptions += _excepted(sample, lexicon, entries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = lexicon.automaton()
            for batch in bounded(batches, "text"):
                total, words = zip(*(measured(automaton, t) for t in batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(total, pa.float64()), pa.array(words, pa.int64()), batch.column("toxic")], names=["total", "words", "toxic"])

        rows = sample.mapInArrow(run, "total double, words long, toxic boolean").orderBy("total", "words", "toxic").collect()
        total, words, toxic = (np.array(c, float) for c in zip(*rows))
        weight = np.where(toxic > 0, of_all[True] / held[True], of_all[False] / held[False])  # as common as among all labels
        lexicon.curve = _curve(_design(total, words), toxic, weight * len(rows) / weight.sum())
    discard(sample)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """Add each whole text's score: near 1 for toxic texts, near 0 for others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in bounded(batches, text):
            total, words = zip(*(measured(automaton, t) for t in batch.column(text).to_pylist()))
            energy = _design(np.array(total, float), np.array(words, float)) @ np.array(lexicon.curve)
            yield with_added(batch, {out: pa.array(1 / (1 + np.exp(-np.clip(energy, -30, 30))), pa.float64())})

    return docs.mapInArrow(run, added(docs, **{out: T.DoubleType()}))

"""Substring dedup by sliding spans of sentences.

A sentence ends with a word that ends in ``.``, ``!`` or ``?``, at a line feed, or with its text. Every run of ``span``
consecutive sentences with at least ``least_words`` words is hashed (xxh3, 128 bits, over its words, so white space between
them does not count). Of equal runs the one in the document of smallest id, and there the first, stays; the sentences of
all others are removed, each with the white space after it. By default a run has two sentences of any length.

Equal runs inside a document are told apart before the shuffle, and hashes are counted with partial aggregation, so a
passage that a third of all documents share is one row for each task that reads it.

Defined cases: a null or empty text and one without words have no sentences and stay as they are (null: empty). A text
with fewer sentences than ``span`` has no runs. Rows that repeat an id and its text are one document: the same is removed
from each. Texts of one id are documents that follow each other by a hash of the text, and so are texts without an id, which
come after all others. Other columns are kept; columns of the added names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from .arrow import added, bounded, byte_texts, own_names, text_bytes, with_added
from .hashing import words

SPAN = 2
LEAST_WORDS = 0
_STOPS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


class Sentences:
    """The sentences of a batch of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, of = words(data, offsets)
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        last = np.ones(len(starts), bool)
        last[:-1] = (of[1:] != of[:-1]) | _STOPS[data[ends[:-1] - 1]] | (feeds[starts[1:]] > feeds[ends[:-1]])
        #: First word and end (word) of each sentence; the text it lies in.
        self.stop = np.flatnonzero(last) + 1
        self.first = np.concatenate([[0], self.stop[:-1]]).astype(np.int64) if len(self.stop) else self.stop
        self.of = of[self.first]
        self.word_starts, self.word_ends = starts, ends
        #: Number of each text's first sentence (n + 1 entries).
        self.begin = np.searchsorted(self.of, np.arange(len(offsets)))
        self.data, self.offsets = data, offsets

    def spans(self, span: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place (number of the first sentence in its text) and two hashes of every run."""
        head = np.arange(max(0, len(self.first) - span + 1))
        tail = head + span - 1
        fits = (self.of[head] == self.of[tail]) & (self.stop[tail] - self.first[head] >= least_words)
        head, tail = head[fits], tail[fits]
        begin, end = self._said()
        of_run = zip(begin[self.first[head]].tolist(), end[self.stop[tail] - 1].tolist())
        told = b"".join(xxhash.xxh3_128_digest(self.said[a:b]) for a, b in of_run)
        both = np.frombuffer(told, np.uint64).reshape(-1, 2)
        return self.of[head], head - self.begin[self.of[head]], both[:, 0], both[:, 1]

    def _said(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins and ends in ``said``, the words of all texts with one space after each."""
        sizes = self.word_ends - self.word_starts
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        marks = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(marks, self.word_starts, 1)
        np.add.at(marks, self.word_ends, -1)
        said = np.full(int((sizes + 1).sum()), 32, np.uint8)
        inside = np.ones(len(said), bool)
        inside[begin + sizes] = False
        said[inside] = self.data[np.cumsum(marks[:-1], dtype=np.int8) == 1]
        self.said = memoryview(said)
        return begin, begin + sizes

    def without(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts without the marked sentences and the white space after them."""
        keep = np.ones(len(self.data), bool)
        if len(self.first):
            begins = self.word_starts[self.first]
            begins[self.begin[:-1][np.diff(self.begin) > 0]] = self.offsets[:-1][np.diff(self.begin) > 0]
            ends = np.append(begins[1:], 0)
            ends[self.begin[1:][np.diff(self.begin) > 0] - 1] = self.offsets[1:][np.diff(self.begin) > 0]
            edges = np.zeros(len(self.data) + 1, np.int64)
            np.add.at(edges, begins[gone], 1)
            np.add.at(edges, ends[gone], -1)
            keep = np.cumsum(edges[:-1]) == 0
        kept = np.concatenate([[0], np.cumsum(keep)])
        return self.data[keep], kept[self.offsets]


def _text_key(text: str) -> F.Column:
    """A hash of the text: tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def covered(docs: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text_key, places): the first sentences of the runs to remove, of every document that has some."""
    wanted = T.StructType().add("doc_id", docs.schema[doc_id].dataType).add("key", "long").add("h1", "long").add("h2", "long").add("place", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            of, place, h1, h2 = Sentences(*text_bytes(batch.column("text"))).spans(span, least_words)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(place.astype(np.int32))],
                names=wanted.names,
            )

    spans = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _text_key(text).alias("key")).mapInArrow(run, wanted)
    firsts = spans.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    several = cut(spans.join(firsts, ["h1", "h2"]))
    # Of the documents that share the smallest id (or have none) the one of smallest key, and in it the first place.
    of_first = several.where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("h1", "h2")
    heads = of_first.agg(F.min(F.struct("key", "place")).alias("head"))
    here = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.struct("key", "place") == F.col("head"))
    later = several.join(heads, ["h1", "h2"]).where(~here)
    return later.groupBy("doc_id", F.col("key").alias("text_key")).agg(F.collect_set("place").alias("places"))


def dedup(docs: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without repeated runs; adds n_sentences and n_removed."""
    own_id, own_key, own_places = own_names("id", "key", "places")
    found = covered(docs, span, least_words, doc_id, text).toDF(own_id, own_key, own_places)
    joined = docs.join(found, F.col(doc_id).eqNullSafe(F.col(own_id)) & (_text_key(text) == F.col(own_key)), "left").drop(own_id, own_key)
    wanted = added(docs, **{text: T.StringType(), "n_sentences": T.LongType(), "n_removed": T.LongType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text):
            all_of = Sentences(*text_bytes(batch.column(text)))
            places = batch.column(own_places)
            many = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            heads = np.repeat(all_of.begin[:-1], many) + places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            gone = np.zeros(len(all_of.first) + span, bool)
            for step in range(span):
                gone[heads + step] = True
            gone = gone[: len(all_of.first)]
            removed = np.bincount(all_of.of[gone], minlength=batch.num_rows)
            yield with_added(
                batch,
                {text: byte_texts(*all_of.without(gone)), "n_sentences": pa.array(np.diff(all_of.begin)), "n_removed": pa.array(removed)},
            ).select(wanted.names)

    return joined.mapInArrow(run, wanted)


def sql(span: int = SPAN, least_words: int = LEAST_WORDS, table: str = "documents") -> str:
    """doc_id, n_sentences, n_removed and text of every document in DuckDB; ids must be unique."""
    space = r"[\x20\x09-\x0D]"
    ahead = " || ' ' || ".join(["said", *[f"lead(said, {i}) OVER w" for i in range(1, span)]])
    count = " + ".join(["n", *[f"lead(n, {i}) OVER w" for i in range(1, span)]])
    covers = " OR ".join(["coalesce(later, false)", *[f"coalesce(lag(later, {i}) OVER w, false)" for i in range(1, span)]])
    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
parts AS (SELECT doc_id, unnest(regexp_extract_all(t, '^{space}+|[^\x20\x09-\x0D]+{space}*')) AS part,
  generate_subscripts(regexp_extract_all(t, '^{space}+|[^\x20\x09-\x0D]+{space}*'), 1) AS i FROM base),
ended AS (SELECT *, trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS word,
  regexp_matches(part, '[.!?]{space}*$') OR contains(part, chr(10)) AS stop FROM parts),
placed AS (SELECT *, coalesce(sum((stop AND word <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM ended),
sents AS MATERIALIZED (SELECT doc_id, place, string_agg(part, '' ORDER BY i) AS whole, string_agg(word, ' ' ORDER BY i) FILTER (word <> '') AS said,
  count(*) FILTER (word <> '') AS n FROM placed GROUP BY ALL HAVING n > 0),
runs AS MATERIALIZED (SELECT doc_id, place, {ahead} AS run, {count} AS total FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
marked AS MATERIALIZED (SELECT doc_id, place, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) > 1 AS later FROM runs
  WHERE run IS NOT NULL AND total >= {least_words}),
gone AS MATERIALIZED (SELECT s.doc_id, s.place, whole, {covers} AS gone FROM sents s LEFT JOIN marked m ON s.doc_id = m.doc_id AND s.place = m.place
  WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.place)),
done AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(whole, '' ORDER BY place) FILTER (NOT gone), '') AS kept
  FROM gone GROUP BY doc_id)
SELECT b.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(kept, t) AS text FROM base b LEFT JOIN done d ON b.doc_id = d.doc_id"""

"""Phrase collocations by count streams.

Phrases of one to ``LONGEST`` words are counted inside pieces (texts are lower-cased, A-Z only, and cut at punctuation and
line ends), for each language. A phrase counts where it occurs ``least`` times; then all parts of it do as well. So phrases
are counted in three passes: words; pairs of frequent words; longer phrases whose pairs are all frequent. What a pass may
skip it learns from a Bloom filter of fixed size over the frequent phrases of the pass before: a filter errs towards "may be
frequent", so it changes the work and never a count. Its size is a parameter and does not grow with the data.

The frequent phrases with their counts are then kept as two sorted streams, one in prefix order (by words) and one in suffix
order (by words from the last one back). In prefix order a phrase follows its own beginnings, which wait on a stack as deep
as a phrase is long: one scan gives each phrase the counts of all its beginnings, and each beginning whether a phrase of one
word more occurs as often. The suffix stream gives the same for ends. Both scans are merged in lockstep by a sort-merge join,
and no table of counts is hashed. A stream is cut into ranges; a range starts with copies of the beginnings of its first
phrase, so ranges are scanned alone and a common first word is many ranges.

A cut of a phrase after k words has the lift a * n / (l * r), n the words of the language, in thousandths and rounded down,
computed exactly in 38 decimal digits; its lowest cut counts. A phrase inside a longer one that occurs as often is dropped:
it suffices to look at one word more on either side, as counts never grow with length.

Defined cases: null and empty texts and those without words count nothing; a null language is ``und``. Repeated rows count
each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, cut_measured, discard
from .arrow import bounded, text_bytes
from .hashing import Stretches, lowered, mixed

LEAST, LONGEST, FIRST = 100, 5, 2000
FILTER_BITS = 23
_BATCH = 4 << 20
_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, 9]] = True
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_COUNTED = "lang string, phrase string, n long"


class Words:
    """The words of a batch: code in ``vocabulary``, text, and whether the next word stands in the same piece."""

    def __init__(self, batch: pa.RecordBatch, column: str):
        data, offsets = text_bytes(batch.column(column))
        data = lowered(data)
        solid = ~(_SPACE | _BREAK)[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
        ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
        self.of = np.searchsorted(offsets, starts, "right") - 1
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        self.joined = np.zeros(len(starts), bool)
        if len(starts):
            self.joined[:-1] = (self.of[1:] == self.of[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
        sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        said = np.ascontiguousarray(data[solid])
        texts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(said)]).dictionary_encode()
        self.code, self.vocabulary = texts.indices.to_numpy(zero_copy_only=False).astype(np.int64), texts.dictionary
        names = batch.column("lang").dictionary_encode()
        self.langs, self.lang = names.dictionary, names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.of]
        seeds = [int.from_bytes(hashlib.blake2b(str(name).encode(), digest_size=8).digest(), "little") for name in self.langs.to_pylist()]
        self.seed = np.array(seeds, np.uint64)[self.lang] if seeds else np.zeros(0, np.uint64)
        place = np.concatenate([[0], np.cumsum(pc.binary_length(self.vocabulary).to_numpy(zero_copy_only=False))]).astype(np.int64)
        held = np.frombuffer(self.vocabulary.buffers()[2], np.uint8) if len(self.vocabulary) else np.zeros(0, np.uint8)
        self.hash = Stretches(held).hash(place[:-1], place[1:])[self.code]

    def keys(self, size: int) -> np.ndarray:
        """Hashes for the filters of the phrases of one or two words that begin at each word."""
        key = self.hash
        if size == 2:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([key[1:], key[:1]]))
        return mixed(key ^ self.seed)

    def counted(self, heads: np.ndarray, size: int) -> pa.RecordBatch:
        """How often each phrase of ``size`` words at ``heads`` occurs in the batch."""
        same = self.lang[heads]
        for step in range(size):
            same = np.unique(same * max(1, len(self.vocabulary)) + self.code[heads + step], return_inverse=True)[1]
        _, first, many = np.unique(same, return_index=True, return_counts=True)
        first = heads[first]
        parts = [self.vocabulary.take(pa.array(self.code[first + step])) for step in range(size)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if size > 1 else parts[0]
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(self.lang[first])), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(many)], names=["lang", "phrase", "n"]
        )


def _slots(key: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [(key & mask).astype(np.int64), ((key >> np.uint64(bits)) & mask).astype(np.int64)]


def _filter(frequent: DataFrame, size: int, bits: int) -> np.ndarray:
    """Bloom filter of phrases of one or two words: ``2**bits`` bits, the only thing that comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "phrase"):
            found = Words(batch, "phrase")
            heads = np.flatnonzero(np.concatenate([[True], found.of[1:] != found.of[:-1]])) if len(found.of) else np.zeros(0, np.int64)
            slots = np.unique(np.concatenate(_slots(found.keys(size)[heads], bits)))
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(np.left_shift(np.uint64(1), (slots & 63).astype(np.uint64)).view(np.int64))], names=["slot", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    held = np.zeros(1 << (bits - 6), np.uint64)
    held[rows["slot"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(held.view(np.uint8), bitorder="little")


def _may_be(packed: bytes, bits: int):
    held = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)

    def test(key: np.ndarray) -> np.ndarray:
        first, second = _slots(key, bits)
        return held[first] & held[second]

    return test


def _pass(texts: DataFrame, sizes: list[int], known: np.ndarray | None, bits: int) -> DataFrame:
    """Counts (lang, phrase, n) of the phrases of ``sizes`` words whose parts of one word less, or two, ``known`` lets by."""
    packed = None if known is None else np.packbits(known, bitorder="little").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = None if packed is None else _may_be(packed, bits)
        for batch in bounded(batches, "text", _BATCH):
            found = Words(batch, "text")
            heads = np.arange(len(found.code))
            if sizes[0] == 2:
                good = test(found.keys(1))
                heads = heads[found.joined & good & np.concatenate([good[1:], [False]])]
            elif sizes[0] == 3:
                pair = found.joined & test(found.keys(2))
                heads = np.flatnonzero(pair)
            for size in sizes:
                if size > 2:  # one pair more
                    heads = heads[heads + size - 2 < len(pair)]
                    heads = heads[pair[heads + size - 2]]
                if len(heads):
                    yield found.counted(heads, size)

    counted = texts.mapInArrow(run, _COUNTED)
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, phrase, n) that occur at least ``least`` times, and the words (lang, n) of each language; stored."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = cut(_pass(texts, [1], None, bits))
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
    tables = [cut(words.where(F.col("n") >= least))]
    discard(words)
    for sizes in [[2], list(range(3, longest + 1))]:
        if sizes and sizes[0] <= longest:
            known = _filter(tables[-1], sizes[0] - 1, bits)
            tables.append(cut(_pass(texts, sizes, known, bits).where(F.col("n") >= least)))
    phrases = tables[0]
    for table in tables[1:]:
        phrases = phrases.unionByName(table)
    return phrases, totals


def _scan(counts: DataFrame, name: str) -> DataFrame:
    """The stream (lang, words, n) in order: each phrase with the counts of its beginnings, shortest first, in ``name``, and
    whether one word more occurs as often (``held``). A phrase that several ranges know has a row for each."""
    placed = counts.orderBy("lang", "words").withColumn("range", F.shiftright(F.monotonically_increasing_id(), 33))
    placed = cut(placed)
    heads = placed.groupBy("range").agg(F.min(F.struct("lang", "words")).alias("head")).collect()  # a row for each range
    copies = [(h.head.lang, h.head.words[:k], h.range) for h in heads for k in range(1, len(h.head.words))]
    ahead = counts.sparkSession.createDataFrame(copies, "lang string, words array<string>, range long")
    again = placed.drop("range").join(F.broadcast(ahead), ["lang", "words"])  # fewer rows than ranges times words of a phrase
    rows = placed.withColumn("copy", F.lit(False)).unionByName(again.withColumn("copy", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [lang, words, n, held] of the phrases that the next one may begin with
        now = None
        for batch in batches:
            done = []
            for at, lang, words, n in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "words", "n"))):
                while stack and (now != at or stack[-1][0] != lang or words[: len(stack[-1][1])] != stack[-1][1]):
                    done.append(stack.pop())
                now = at
                if stack and len(stack[-1][1]) == len(words) - 1 and stack[-1][2] == n:
                    stack[-1][3] = True
                stack.append([lang, words, n, False, [s[2] for s in stack]])
            yield _table(done, name)
        yield _table(stack, name)

    dealt = rows.repartition("range").sortWithinPartitions("range", "lang", "words")
    return dealt.select("range", "lang", "words", "n").mapInArrow(run, f"lang string, words array<string>, n long, held boolean, {name} array<long>")


def _table(rows: list[list], name: str) -> pa.RecordBatch:
    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "words", "n", "held", name])


def _stream(counts: DataFrame, name: str) -> DataFrame:
    """One row for each phrase: copies of a phrase in several ranges agree but for ``held``."""
    found = _scan(counts, name).groupBy("lang", "words")
    return found.agg(F.max("n").alias("n"), F.max("held").alias("held"), F.max(name).alias(name))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", bits: int = FILTER_BITS) -> DataFrame:
    """Rows (lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer one stands for."""
    phrases, totals = frequent_phrases(docs, least, longest, text, lang, bits)
    counts = phrases.select("lang", F.split("phrase", " ", -1).alias("words"), "n")
    ahead = _stream(counts, "lefts")
    back = _stream(counts.withColumn("words", F.reverse("words")), "rights").withColumn("words", F.reverse("words"))
    both = ahead.hint("merge").join(back.select("lang", "words", F.col("held").alias("held_too"), "rights"), ["lang", "words"])
    left = both.where((F.size("words") > 1) & ~F.col("held") & ~F.col("held_too")).withColumnRenamed("n", "a").join(totals, "lang")
    exact = "decimal(19,0)"

    def lift(k):
        l, r = F.get("lefts", k - 1), F.get("rights", F.size("words") - k - 1)
        above = (F.col("a") * 1000).cast(exact) * F.col("n").cast(exact)
        return F.struct(F.call_function("div", above, l.cast(exact) * r.cast(exact)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    lowest = F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lift))
    scored = left.withColumn("cut", lowest)
    return scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def first_phrases(found: DataFrame, first: int = FIRST) -> DataFrame:
    """Each language's first phrases, ranked; tasks keep no more than ``first`` of a language before they meet."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, longest: int = LONGEST, first: int = FIRST, table: str = "documents") -> str:
    """The ranked phrases of every language in DuckDB."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS size, ws[i:i+{k - 1}] AS words FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM pieces)" for k in range(1, longest + 1)
    )
    return rf"""
WITH pieces AS MATERIALIZED (SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM {table})) WHERE len(ws) > 0),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
counted AS MATERIALIZED (SELECT lang, size, words, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
held AS (SELECT s.lang, s.words FROM counted s JOIN counted l ON s.lang = l.lang AND l.size = s.size + 1 AND l.a = s.a
  AND (l.words[1:s.size] = s.words OR l.words[2:s.size + 1] = s.words)),
cuts AS (SELECT lang, size, words, a, unnest(range(1, size)) AS k FROM counted c ANTI JOIN held USING (lang, words) WHERE size > 1),
scored AS (SELECT c.lang, c.words, c.a, x.a AS l, y.a AS r, n, k, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM cuts c
  JOIN counted x ON x.lang = c.lang AND x.words = c.words[1:k] JOIN counted y ON y.lang = c.lang AND y.words = c.words[k + 1:c.size] JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT lang, words, arg_min({{'a': a, 'l': l, 'r': r, 'n': n, 'score': score}}, (score, k)) AS x FROM scored GROUP BY lang, words),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, x.a DESC, phrase) AS rank, phrase, x.a AS a, x.l AS l, x.r AS r, x.n AS n, x.score AS score
  FROM (SELECT lang, array_to_string(words, ' ') AS phrase, x FROM lowest))
SELECT * FROM ranked WHERE rank <= {first}"""

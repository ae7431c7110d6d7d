"""Exact substring dedup by sorted sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it starts at another place too, in the same document or in
another. The method is that of difference-cover suffix sorting, cut off at this length:

1. *Sample* positions so that of two equal strings the same offset is sampled in both. A difference cover of residues
   (:func:`residues`) does this for any pair; :func:`content` samples by the bytes themselves (the smallest hash in each
   window) and so needs far fewer positions. Either way each string of ``length`` bytes has a sampled position in its
   first ``reach + 1`` bytes that its equals have too.
2. *Name* each sampled position by the bytes from it that lie in every such string, and keep the names that occur again.
3. *Merge the other suffixes*: the string that starts ``d`` bytes before a sampled position is known by ``d``, the ``d``
   bytes before it, its name and the bytes after the named ones. Only positions with a name that occurs again take part.
4. *Compare neighbours*: sorted by these keys, equal strings are adjacent. The strings found around one position all
   cover it, so they make one run of bytes.

Texts that occur again whole are told by a hash of the text, and only one of them takes part in steps 3 and 4. Names
that occur twice in what one task has read are known to occur again, so a name that a third of all documents hold is
sent once by each batch. Groups of more than ``hot`` positions are not compared in one task but by counting keys.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing. Rows are documents: a
repeated row is a copy. Rows without an id are told apart by their texts. What is left is bytes; a character cut in two
by a removed run leaves its other bytes. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..lineage import cut
from .arrow import added, bounded, byte_texts, own_names, text_bytes
from .hashing import Stretches, mixed, powers

LENGTH = 200
#: Bytes before a position that a string with it may start, for the sample by content.
REACH = 99
GRAM = 16
HOT = 20_000
#: Positions compared, positions whose keys are made, and bytes hashed at a time.
COMPARED, KEYED, HASHED = 1 << 14, 1 << 11, 1 << 18
#: Bytes of texts in which equal positions are told apart before the shuffle.
TOGETHER = 4 << 20
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)

Sample = Callable[[np.ndarray, np.ndarray, Stretches], np.ndarray]


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each ``width`` values in a row."""
    step, found = 1, values
    while 2 * step <= width:
        found = best(found[:-step], found[step:])
        step *= 2
    over = width - step
    return best(found[: len(found) - over], found[over:]) if over else found


def content(reach: int = REACH, gram: int = GRAM) -> Sample:
    """Positions whose hash of ``gram`` bytes is the smallest of ``reach + 1`` in a row."""

    def sample(data: np.ndarray, offsets: np.ndarray, hashes: Stretches) -> np.ndarray:
        count = len(data) - gram + 1
        if count <= reach:
            return np.zeros(0, np.int64)
        at = np.arange(count)
        grams = hashes.hash(at, at + gram)
        for end in offsets[1:]:  # those that cross into the next text
            grams[max(0, end - gram + 1) : end] = _TOP
        least = _sliding(grams, reach + 1, np.minimum)
        padded = np.concatenate([np.zeros(reach, _U), least, np.zeros(reach, _U)])
        return np.flatnonzero((_sliding(padded, reach + 1, np.maximum) == grams) & (grams != _TOP))

    return sample


def residues(modulus: int, cover: tuple[int, ...]) -> Sample:
    """Positions (within their text) whose residue lies in a difference cover of the modulus; their reach is modulus - 1."""
    marks = np.isin(np.arange(modulus), cover)
    if {(a - b) % modulus for a in cover for b in cover} != set(range(modulus)):
        raise ValueError("not a difference cover")

    def sample(data: np.ndarray, offsets: np.ndarray, hashes: Stretches) -> np.ndarray:
        place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        return np.flatnonzero(marks[place % modulus])

    return sample


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents with ``_id`` and ``_key`` (31 bits of the text's hash), which tell them apart, and no null texts.

    Both joins of texts read this frame with all its columns, so Spark shuffles the texts once and reads them twice.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c != text]
    return docs.select(
        *rest, body.alias(text), F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(body)).alias("_id"),
        F.xxhash64(body, F.lit(7)).bitwiseAND(F.lit(0x7FFFFFFF)).alias("_key"),
    )


def _named(docs: DataFrame, text: str, sample: Sample, size: int) -> DataFrame:
    """Rows (name, id, at, known): sampled positions with ``size`` bytes after them in their text.

    ``at`` is key * 2**32 + position. Of a name's positions in one batch the first has the name, the others, known to
    occur again, have a key of their own.
    """

    def sampled(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names and places of the sampled positions, and how many each text has."""
        data, offsets = text_bytes(part.column("text"))
        hashes = Stretches(data)
        found = sample(data, offsets, hashes)
        of = np.searchsorted(offsets, found, "right") - 1
        inside = found + size <= offsets[of + 1]
        found, of = found[inside], of[inside]
        return hashes.hash(found, found + size), found - offsets[of], np.bincount(of, minlength=part.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", TOGETHER):
            told = [sampled(part) for part in bounded([batch], "text", HASHED)]
            rows = np.concatenate([[0], np.cumsum([len(count) for _, _, count in told])])
            names, place = (np.concatenate([x[i] for x in told]) for i in (0, 1))
            of = np.repeat(np.arange(rows[-1]), np.concatenate([count for _, _, count in told]))
            _, first, group, count = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
            known = count[group] > 1
            later = np.ones(len(names), bool)
            later[first] = False
            at = (batch.column("_key").to_numpy()[of] << 32) | place
            ids = batch.column("_id").to_numpy()[of]
            names[later] = mixed(names[later] ^ mixed(at[later].astype(_U)) + mixed(ids[later].astype(_U)))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(ids), pa.array(at), pa.array(known)], names=["name", "id", "at", "known"])

    return docs.select("_id", "_key", F.col(text).alias("text")).mapInArrow(run, "name long, id long, at long, known boolean")


def _cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches ``starts:ends`` as a binary column."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[index])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).cast(pa.binary())


def _around(work: DataFrame, text: str, reach: int, length: int) -> DataFrame:
    """Rows (name, before, after, low, high, id, key, at, known): each position in ``_places`` with the bytes around it.

    A string of ``length`` bytes can start ``low`` to ``high`` bytes before the position. Of positions alike in all
    bytes around one is sent by each batch; it and the others are ``known``: all these strings occur again. The others
    go under names of their own, without bytes.
    """
    size = length - reach

    def placed(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        """The positions in a part's texts, their names, and a hash of all bytes around each."""
        data, offsets = text_bytes(part.column(text))
        hashes, places = Stretches(data), part.column("_places")
        of = np.repeat(np.arange(part.num_rows), pc.list_value_length(places).to_numpy())
        at = offsets[of] + places.flatten().to_numpy()
        left, right = np.maximum(at - reach, offsets[of]), np.minimum(at + length, offsets[of + 1])
        low, high = np.maximum(0, length - (right - at)), at - left
        fits = low <= high
        of, at, left, right, low, high = (x[fits] for x in (of, at, left, right, low, high))
        return {
            "id": part.column("_id").to_numpy()[of], "key": part.column("_key").to_numpy()[of], "place": at - offsets[of], "at": at, "left": left, "right": right,
            "low": low, "high": high, "name": hashes.hash(at, at + size), "alike": hashes.hash(left, right) ^ mixed(high.astype(_U) + _U(1)),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text, TOGETHER):
            parts = list(bounded([batch], text, HASHED))
            told = [placed(part) for part in parts]
            _, first, group, count = np.unique(np.concatenate([x["alike"] for x in told]), return_index=True, return_inverse=True, return_counts=True)
            others = np.ones(len(group), bool)
            others[first] = False
            edges = np.cumsum([len(x["at"]) for x in told])[:-1]
            for part, x, later, many in zip(parts, told, np.split(others, edges), np.split(count[group], edges)):
                data, _ = text_bytes(part.column(text))
                x["name"][later] = mixed(x["name"] ^ mixed(x["place"].astype(_U)) + mixed(x["id"].astype(_U)))[later]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["name"].view(np.int64)), _cuts(data, np.where(later, x["at"], x["left"]), x["at"]),
                     _cuts(data, np.where(later, x["right"], x["at"] + size), x["right"]), *(pa.array(x[c]) for c in ("low", "high", "id", "key", "place")), pa.array(many > 1)],
                    names=["name", "before", "after", "low", "high", "id", "key", "at", "known"],
                )

    kind = "name long, before binary, after binary, low long, high long, id long, key long, at long, known boolean"
    return work.mapInArrow(run, kind)


def _sums(column: pa.ChunkedArray, width: int, backwards: bool) -> np.ndarray:
    """Hashes of the first 0 .. width bytes of each value (of the last ones, from the end on)."""
    column = column.combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    found = np.zeros((len(column), width + 1), np.uint64)
    step = np.arange(width)
    index = offsets[1:, None] - 1 - step if backwards else offsets[:-1, None] + step
    there = step < np.diff(offsets)[:, None]
    values = np.where(there, mixed(data[np.where(there, index, 0)].astype(_U) + _U(1 + 256 * backwards)) if len(data) else _U(0), _U(0))
    np.cumsum(values * powers(_STEP, width), axis=1, dtype=np.uint64, out=found[:, 1:])
    return found


_STEP = 0xD6E8FEB86659FD93


def _keys(rows: pa.Table, reach: int) -> np.ndarray:
    """Keys of the strings that start 0 .. reach bytes before each position."""
    found = np.empty((rows.num_rows, reach + 1), np.uint64)
    for start in range(0, rows.num_rows, KEYED):
        part = rows.slice(start, KEYED)
        before, after = _sums(part.column("before"), reach, True), _sums(part.column("after"), reach, False)
        names = part.column("name").to_numpy().view(np.uint64)
        found[start : start + KEYED] = mixed(before + mixed(after[:, ::-1] ^ names[:, None]))
    return found


def _compared(around: DataFrame, reach: int, hot: int) -> DataFrame:
    """Rows (id, key, at, low, high, sign): the least and most bytes before a position that repeated strings start.

    Of larger groups than ``hot`` come the keys of single strings (``sign``; low = high) to be counted instead.
    """

    def told(rows: pa.Table, low: np.ndarray, high: np.ndarray, which: np.ndarray, sign: np.ndarray | None = None) -> pa.RecordBatch:
        columns = [rows.column(c).to_numpy()[which] for c in ("id", "key", "at")] + [low, high]
        signs = pa.nulls(len(low), pa.int64()) if sign is None else pa.array(sign.view(np.int64))
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), signs], names=["id", "key", "at", "low", "high", "sign"])

    def compare(rows: pa.Table) -> pa.RecordBatch:
        known = rows.column("known").to_numpy()
        least, most = (rows.column(c).to_numpy() for c in ("low", "high"))
        low, high = np.where(known, least, reach + 1), np.where(known, most, -1)
        keys = _keys(rows, reach)
        for back in range(reach + 1):
            able = np.flatnonzero((least <= back) & (back <= most))
            order = able[np.argsort(keys[able, back], kind="stable")]
            same = keys[order[1:], back] == keys[order[:-1], back]  # neighbours
            again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            low[again] = np.minimum(low[again], back)
            high[again] = np.maximum(high[again], back)
        found = np.flatnonzero(high >= 0)
        return told(rows, low[found], high[found], found)

    def listed(group: pa.Table) -> Iterator[pa.RecordBatch]:
        for start in range(0, group.num_rows, KEYED):
            rows, back = group.slice(start, KEYED), np.arange(reach + 1)
            least, most = (rows.column(c).to_numpy() for c in ("low", "high"))
            row, at = np.nonzero((least[:, None] <= back) & (back <= most[:, None]))
            yield told(rows, at, at, row, mixed(_keys(rows, reach)[row, at] + at.astype(_U)))

    def known(rows: pa.Table) -> pa.RecordBatch:
        found = np.flatnonzero(rows.column("known").to_numpy())
        return told(rows, rows.column("low").to_numpy()[found], rows.column("high").to_numpy()[found], found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, listing = None, None  # rows not compared yet; the name whose keys are being listed
        for batch in batches:
            for start in range(0, batch.num_rows, COMPARED):
                part = batch.slice(start, COMPARED)
                rest = pa.Table.from_batches([part] if rest is None else [*rest.to_batches(), part])
                names = rest.column("name").to_numpy()
                if listing is not None:  # the rest of a large group
                    end = int(np.searchsorted(names != listing, True))
                    if end:
                        yield from listed(rest.slice(0, end))
                        yield known(rest.slice(0, end))
                    rest, names = rest.slice(end), names[end:]
                    listing = None if len(names) else listing
                edges = np.flatnonzero(names[1:] != names[:-1]) + 1
                last = int(edges[-1]) if len(edges) else 0  # where the last group begins, which may go on
                if last:
                    yield compare(rest.slice(0, last))
                    rest = rest.slice(last)
                if rest.num_rows > hot:
                    listing = rest.column("name")[0].as_py()
                    yield from listed(rest)
                    yield known(rest)
                    rest = rest.slice(rest.num_rows)
        if rest is not None and rest.num_rows:
            yield compare(rest)

    ordered = around.repartition("name").sortWithinPartitions("name")
    return ordered.mapInArrow(run, "id long, key long, at long, low long, high long, sign long")


def _spans(bodies: DataFrame, text: str, length: int, sample: Sample, reach: int, hot: int) -> DataFrame:
    """Rows (_id, _key, _spans): the runs of bytes to remove, as start and end, of every prepared document that has some."""
    size = F.octet_length(text).cast("long")
    facts = cut(bodies.select("_id", "_key", size.alias("n"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(7)).alias("h2")).where(F.col("n") >= length))
    copies = facts.groupBy("h1", "h2", "n").agg(F.count("*").alias("many"), F.min("_id").alias("first")).where("many > 1")
    copied = cut(facts.join(copies, ["h1", "h2", "n"]).select("_id", "_key", "n", (F.col("_id") == F.col("first")).alias("first")).distinct())

    named = _named(bodies.where(size >= length), text, sample, length - reach)
    again = named.withColumn("many", F.count("*").over(Window.partitionBy("name"))).where("many > 1 or known")
    places = again.groupBy(F.col("id").alias("_id"), F.shiftright("at", 32).alias("_key")).agg(
        F.collect_list((F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).cast("long")).alias("_places")
    )
    needed = places.join(copied.where("not first").select("_id", "_key"), ["_id", "_key"], "left_anti")

    told = _compared(_around(bodies.join(needed, ["_id", "_key"]), text, reach, length), reach, hot)
    counted = told.where("sign is not null").withColumn("many", F.count("*").over(Window.partitionBy("sign"))).where("many > 1")
    runs = told.where("sign is null").unionByName(counted.drop("many")).select(
        F.col("id").alias("_id"), F.col("key").alias("_key"), (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end")
    )
    whole = copied.select("_id", "_key", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    return runs.unionByName(whole).groupBy("_id", "_key").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))


def _gone(batch: pa.RecordBatch, text: str, runs: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of a batch, and a mark for each byte that a run covers."""
    data, offsets = text_bytes(batch.column(text))
    column = batch.column(runs)
    of = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = column.flatten()
    edges = np.zeros(len(data) + 1, np.int64)
    np.add.at(edges, offsets[of] + flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64), 1)
    np.add.at(edges, offsets[of] + flat.field("end").to_numpy(zero_copy_only=False).astype(np.int64), -1)
    return data, offsets, np.cumsum(edges[:-1]) > 0


def _counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks there are before each offset."""
    return np.concatenate([[0], np.cumsum(mask)])[offsets]


def dedup(
    docs: DataFrame, length: int = LENGTH, sample: Sample | None = None, reach: int = REACH, doc_id: str = "doc_id", text: str = "text", hot: int = HOT
) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): one for each document, ``kept`` holds the bytes left."""
    bodies = _prepared(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    joined = bodies.join(_spans(bodies, "text", length, sample or content(reach), reach, hot), ["_id", "_key"], "left")
    wanted = T.StructType().add("doc_id", docs.schema[doc_id].dataType)
    wanted = wanted.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", HASHED):
            data, offsets, gone = _gone(batch, "text", "_spans")
            heads = gone.copy()
            heads[1:] &= ~gone[:-1]
            starts = offsets[:-1][np.diff(offsets) > 0]
            heads[starts] = gone[starts]  # a run ends with its text
            kept = _counts(~gone, offsets)
            numbers = [pa.array(np.diff(x)) for x in (offsets, _counts(gone, offsets), _counts(heads, offsets))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, _cuts(data[~gone], kept[:-1], kept[1:])], names=wanted.names)

    return joined.mapInArrow(run, wanted)


def dedup_text(
    docs: DataFrame, length: int = LENGTH, sample: Sample | None = None, reach: int = REACH, doc_id: str = "doc_id", text: str = "text", hot: int = HOT,
    out: str = "n_removed",
) -> DataFrame:
    """The documents with what is left of their texts, and ``out``, the bytes gone; other columns are kept, whatever their names.

    A character of which a run covers some bytes goes whole. Every place of a repeated string goes, the first too. A null
    text comes back empty; a column that is named ``out`` already is replaced.
    """
    own = dict(zip(docs.columns, own_names(*docs.columns)))
    body = own[text]
    bodies = _prepared(docs.toDF(*own.values()), own[doc_id], body)
    joined = bodies.join(_spans(bodies, body, length, sample or content(reach), reach, hot), ["_id", "_key"], "left")
    wanted = added(docs, **{text: T.StringType(), out: T.LongType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, body, HASHED):
            data, offsets, gone = _gone(batch, body, "_spans")
            character = np.cumsum((data & 0xC0) != 0x80) - 1  # a character's first byte is no continuation
            touched = np.zeros(int(character[-1]) + 1 if len(data) else 0, bool)
            touched[character[gone]] = True
            gone = touched[character]
            columns = {text: byte_texts(data[~gone], _counts(~gone, offsets)), out: pa.array(np.diff(_counts(gone, offsets)))}
            columns = {name: batch.column(own[name]) for name in own if name not in columns} | columns
            yield pa.RecordBatch.from_arrays([columns[name] for name in wanted.names], names=wanted.names)

    return joined.mapInArrow(run, wanted)

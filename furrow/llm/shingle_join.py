"""Jaccard join of word n-gram sets by PartEnum signatures.

Two sets of sizes a and b with a Jaccard index of at least t differ in at most ``(a + b) * (1 - t) / (1 + t)`` elements.
Sizes are cut into bands. In the band of the smaller of two sets let k be the largest such number; the domain of
n-grams is cut into more than k parts by a hash, so in all but k parts the two sets hold the same elements. The elements
of a set in one part are a signature, enumerated for all parts, once for the set's own band and once for the band below
if a set there can be similar. Similar sets share a signature.

Parts are some more than k + 1, and all orders signatures by how many sets have them. Of its signatures a set needs only
the k + 1 least frequent: the least frequent of those that two similar sets share is among these for both. So groups that
share a signature of common n-grams alone are left out where that loses nothing. A set with k or fewer filled parts uses
its empty parts as signatures too.

Sets, not documents, are joined: documents of equal sets are one node. In every group each set is compared with one
lead, some rounds with other leads; what this links are components. Groups that still hold several components are
compared whole, in tiles of bounded size. Tiles get the sets' parity maps first; sets that no map of another component
leaves a partner go no further. The others come whole to the tile and are checked there, the likeliest pairs first, and
the tile tells only the links that join two of its components, fewer than it has sets. So no group is listed pair by pair. Every link is checked on the sets themselves.

Defined cases: null and empty texts have no n-grams and no links; a text with fewer words than ``n`` is one n-gram.
Rows without an id have no links and no component; rows of one id are one node with the links of all. Repeated rows stay
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from .arrow import bounded, text_bytes
from .components import components
from .hashing import Stretches, lowered, mixed, word_hashes, words

N = 5
LIKE = Fraction(4, 5)
#: Ratio of the largest to the smallest size of a band, and share of parts beyond k + 1.
BAND, SPARE = 1.7, 0.12
#: Sets on a side of a tile of a large group, and n-grams (fewer sets where sets are large); words of maps compared at once.
TILE, GRAMS, WORDS = 1024, 1 << 22, 1 << 21
#: Rounds of leads at most.
ROUNDS = 2
_U = np.uint64


def shingles(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-grams of all texts, end to end, and where each text's begin (texts + 1 entries)."""
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, of = words(data, offsets)
    count = np.bincount(of, minlength=len(offsets) - 1)
    begin = np.concatenate([[0], np.cumsum(count)])
    grams = np.maximum(count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(grams)])
    heads = np.repeat(begin[:-1] - first[:-1], grams) + np.arange(first[-1])
    tails = np.minimum(heads + n, np.repeat(begin[1:], grams))
    hashes = Stretches(word_hashes(data, starts, ends)).hash(heads, tails)
    parts = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate([*parts, np.zeros(0, _U)]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    return total[begin[1:]] - total[begin[:-1]]


def names(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set: 54 bits that serve as its address, and 64 that tell apart sets of one address."""
    size = np.diff(begin).astype(_U)
    address = mixed(_sums(mixed(hashes ^ _U(0x2545F4914F6CDD1D)), begin) + size) >> _U(10)
    return address.astype(np.int64), mixed(_sums(mixed(hashes ^ _U(0x9E6C63D0876A9A35)), begin) + size).view(np.int64)


class Bands:
    """Bands of set sizes, and the number of parts in each."""

    def __init__(self, like: Fraction = LIKE, ratio: float = BAND):
        self.like, self.ends, self.ratio = like, [0], ratio

    def _reach(self, size: int) -> None:
        while self.ends[-1] < size:
            self.ends.append(max(self.ends[-1] + 1, int(self.ends[-1] * self.ratio)))

    def of(self, size: np.ndarray) -> np.ndarray:
        """Number of the band of each size, from 1 on."""
        self._reach(int(size.max(initial=1)))
        return np.searchsorted(self.ends, size, "left")

    def differ(self, band: int) -> int:
        """The most elements in which two similar sets differ, of which the smaller lies in the band."""
        small = self.ends[band]
        return int((small + int(small / self.like)) * (1 - self.like) / (1 + self.like))

    def parts(self, band: int) -> int:
        least = self.differ(band) + 1
        return least + int(least * SPARE) + 1


def signatures(hashes: np.ndarray, begin: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of a batch of sets: the set, the signature, the band's lowest bit, and how many it can spare."""
    size = np.diff(begin)
    own = bands.of(size)
    found = []
    for below in (0, 1):
        band = own - below
        ends = np.array(bands.ends)
        used = (size > 0) & (band >= 1)
        if below:
            used &= size * bands.like.numerator <= ends[np.maximum(band, 0)] * bands.like.denominator
        for b in np.unique(band[used]):
            rows = np.flatnonzero(used & (band == b))
            count = bands.parts(b)
            sizes = size[rows]
            of = np.repeat(np.arange(len(rows)), sizes)
            at = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            salted = mixed(hashes[at] + mixed(np.array([b], _U)))
            part = ((salted >> _U(32)) * _U(count) >> _U(32)).astype(np.int64)
            cell = of * count + part
            total = np.zeros(len(rows) * count, _U)
            np.add.at(total, cell, mixed(salted ^ _U(0xD1342543DE82EF95)))
            filled = np.bincount(cell, minlength=len(total)) > 0
            full = filled.reshape(len(rows), count).sum(1)
            spare = np.clip(full - (bands.differ(b) + 1), 0, 255)
            filled |= np.repeat(full <= bands.differ(b), count)  # then empty parts count as well
            cells = np.flatnonzero(filled)
            owner, number = cells // count, (cells % count).astype(_U)
            sign = mixed(total[cells] + mixed(number + (_U(b) << _U(32))))
            found.append((rows[owner], sign, np.full(len(cells), b & 1), spare[owner]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, _U, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found))


def _signed(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """Rows (sign, word): word holds the set's address, the band's lowest bit and the spare signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)  # a set met before by this task has been told already
        for batch in bounded(batches, "text"):
            hashes, begin = shingles(batch.column("text"), n)
            address, _ = names(hashes, begin)
            fresh = np.zeros(len(address), bool)
            fresh[np.unique(address, return_index=True)[1]] = True
            fresh &= ~np.isin(address, seen)
            seen = np.union1d(seen, address)
            size = np.where(fresh, np.diff(begin), 0)
            kept = np.repeat(fresh, np.diff(begin))
            begin = np.concatenate([[0], np.cumsum(size)])
            of, sign, bit, spare = signatures(hashes[kept], begin, bands)
            yield pa.RecordBatch.from_arrays([pa.array(sign.view(np.int64)), pa.array(address[of] << 9 | bit << 8 | spare)], names=["sign", "word"])

    return docs.select("text").mapInArrow(run, "sign long, word long")


def candidates(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """Rows (sign, address): sets that share a signature with another set, on the signatures that count."""
    group = Window.partitionBy("sign")
    shared = (
        _signed(docs, n, bands)
        .withColumns({"low": F.min("word").over(group), "high": F.max("word").over(group), "often": F.count("*").over(group)})
        .where("low < high")
        .select("sign", "word", "often")
        .dropDuplicates(["sign", "word"])
    )
    rare = Window.partitionBy(F.shiftright("word", 8)).orderBy(F.desc("often"), F.desc("sign"))
    return (
        shared.withColumn("place", F.row_number().over(rare))
        .where(F.col("place") > F.col("word").bitwiseAND(F.lit(255)))
        .select("sign", F.shiftright("word", 9).alias("address"))
        .distinct()
    )


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n_shingles, address, name) for documents (doc_id, text)."""
    wanted = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n_shingles", "long").add("address", "long").add("name", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            hashes, begin = shingles(batch.column("text"), n)
            address, name = names(hashes, begin)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(begin)), pa.array(address), pa.array(name)], names=wanted.names)

    return docs.select("doc_id", "text").mapInArrow(run, wanted)


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes cut to 48 bits."""
    return np.unique(hashes >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray, like: Fraction) -> bool:
    small, large = sorted((len(a), len(b)))
    if small * like.denominator < large * like.numerator:
        return False
    common = small + large - len(np.union1d(a, b))
    return common * like.denominator >= (small + large - common) * like.numerator


def _parity(hashes: np.ndarray) -> bytes:
    """One bit for each value of a hash: whether an odd number of elements has it. Each element that two sets differ in
    changes one bit, so two maps differ in no more bits than the sets in elements. A map has at least twice as many bits
    as the set elements, a power of two."""
    bits = max(64, 1 << (2 * len(hashes)).bit_length())
    return np.packbits(np.bincount((hashes >> _U(20)).astype(np.int64) % bits, minlength=bits) & 1).tobytes()


def _folded(maps: list[bytes], width: int) -> np.ndarray:
    """Maps as rows of 64-bit numbers, all of ``width`` bytes: halves of wider ones are laid over each other."""
    found = np.zeros((len(maps), width // 8), np.uint64)
    for i, one in enumerate(maps):
        found[i] = np.bitwise_xor.reduce(np.frombuffer(one, np.uint64).reshape(-1, width // 8), axis=0)
    return found


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which maps differ, along the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _within(bits: np.ndarray, total: np.ndarray, like: Fraction) -> np.ndarray:
    """Whether sets of so many elements together can be similar if they differ in at least ``bits``."""
    up, down = like.numerator, like.denominator
    return bits * (down + up) <= total * (down - up)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows (node, address, size, bits, grams) of the sets in ``wanted`` (node, address, name), read from one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            hashes, begin = shingles(batch.column("text"), n)
            address, name = names(hashes, begin)
            right = (address == batch.column("address").to_numpy()) & (name == batch.column("name").to_numpy())
            each = [hashes[a:b] for a, b in zip(begin, begin[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(address), pa.array(np.diff(begin)), pa.array([_parity(h) for h in each], pa.binary()),
                 pa.array([_packed(h) for h in each], pa.binary())],
                names=found.names,
            ).filter(pa.array(right))

    found = T.StructType().add("node", wanted.schema["node"].dataType).add("address", "long").add("size", "long").add("bits", "binary").add("grams", "binary")
    return docs.join(wanted, docs["doc_id"] == wanted["node"]).select("node", "address", "name", "text").mapInArrow(run, found)


def _checked(pairs: DataFrame, held: DataFrame, like: Fraction) -> DataFrame:
    """Links (a, b) between nodes for those pairs (x, y) of addresses whose sets are similar."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [batch.column(c).to_pylist() for c in ("bits_x", "bits_y")]
            widths = np.array([min(len(x), len(y)) for x, y in zip(*maps)], np.int64)
            differ = np.zeros(len(widths), np.int64)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                differ[rows] = _differ(*(_folded([side[i] for i in rows], width) for side in maps))
            total = batch.column("size_x").to_numpy() + batch.column("size_y").to_numpy()
            yield batch.filter(pa.array(_within(differ, total, like), pa.bool_())).select(["x", "y"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("grams_x").to_pylist(), batch.column("grams_y").to_pylist())
            yield batch.filter(pa.array([similar(_unpacked(x), _unpacked(y), like) for x, y in sides], pa.bool_())).select(["a", "b"])

    def side(pairs: DataFrame, name: str, *columns: str) -> DataFrame:
        """The sets on one side of the pairs: no other set is shuffled."""
        asked = pairs.select(F.col(name).alias("address")).distinct()
        return held.join(asked, "address", "left_semi").select(F.col("address").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    near = pairs.join(side(pairs, "x", "size", "bits"), "x").join(side(pairs, "y", "size", "bits"), "y").mapInArrow(possible, "x long, y long")
    near = cut(near.distinct())
    kind = T.StructType().add("a", held.schema["node"].dataType).add("b", held.schema["node"].dataType)
    both = near.join(side(near, "x", "node", "grams"), "x").join(side(near, "y", "node", "grams"), "y")
    return both.withColumnsRenamed({"node_x": "a", "node_y": "b"}).select("a", "b", "grams_x", "grams_y").mapInArrow(alike, kind)


def _led(groups: DataFrame, turn: int, like: Fraction) -> DataFrame:
    """Pairs (x, y) of each member of a group with the group's lead, another in each turn; members of one component are not
    paired, nor sets whose sizes alone rule it out."""
    rank = F.xxhash64("address", F.lit(turn))
    leads = groups.groupBy("sign").agg(F.min_by(F.struct("address", "label", "low", "high"), rank).alias("lead"))
    up, down = like.numerator, like.denominator
    fits = (F.col("high") * down >= F.col("lead.low") * up) & (F.col("lead.high") * down >= F.col("low") * up)
    led = groups.join(leads, "sign").where(F.col("lead.label") != F.col("label")).where(fits)
    return led.select(F.least("address", "lead.address").alias("x"), F.greatest("address", "lead.address").alias("y")).distinct()


def _split(groups: DataFrame) -> DataFrame:
    """The groups that hold more than one component, once for each set of members."""
    kin = groups.groupBy("sign").agg(
        F.sum(F.xxhash64("address").cast("decimal(38,0)")).alias("kin"), F.count("*").alias("many"), F.max("high").alias("widest"),
        (F.min("label") != F.max("label")).alias("several"),
    ).where("several")
    one = kin.groupBy("kin", "many").agg(F.min("sign").alias("sign"), F.max("widest").alias("widest"))
    return groups.join(one, "sign")


def _forest(label: np.ndarray, first: np.ndarray, second: np.ndarray, alike) -> list[int]:
    """The pairs (rows of ``first`` and ``second``) that link components of ``label`` (numbers from 0), each component pair once."""
    parent = list(range(int(label.max(initial=-1)) + 1))

    def root(one: int) -> int:
        while parent[one] != one:
            parent[one] = one = parent[parent[one]]
        return one

    kept = []
    for at, (a, b, of_a, of_b) in enumerate(zip(first.tolist(), second.tolist(), label[first].tolist(), label[second].tolist())):
        x, y = root(of_a), root(of_b)
        if x != y and alike(a, b):
            parent[x] = y
            kept.append(at)
    return kept


def _possible(maps: np.ndarray, size: np.ndarray, label: np.ndarray, mine: np.ndarray, i: int, j: int, like: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile's sets that have different labels and maps that do not rule them out, and the share they differ in."""
    rows, columns = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    step = max(1, WORDS // max(1, len(columns) * maps.shape[1]))
    found = []
    for start in range(0, len(rows), step):
        some = rows[start : start + step]
        apart = _differ(maps[some, None], maps[columns])
        total = size[some, None] + size[columns]
        fits = _within(apart, total, like) & (label[some, None] != label[columns])
        if i == j:
            fits &= some[:, None] < columns
        r, c = np.nonzero(fits)
        found.append((some[r], columns[c], apart[r, c] / total[r, c]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _by_tile(batches: Iterator[pa.RecordBatch], keys: list[str], compare: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``compare`` of each tile: rows of equal keys, which stand together."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        values = [table.column(k).to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        bounds = [0, *edges.tolist()]  # the last tile may go on
        for start, end in zip(bounds, bounds[1:]):
            yield from compare(table.slice(start, end - start).combine_chunks()).to_batches()
        rest = table.slice(bounds[-1])
    if rest is not None and rest.num_rows:
        yield from compare(rest.combine_chunks()).to_batches()


def _tiled(groups: DataFrame, held: DataFrame, like: Fraction) -> DataFrame:
    """Links (a, b) between nodes of different components within groups (sign, address, label, many, widest), a forest for each tile.

    Maps are dealt to the tiles first. Only sets that a map leaves a partner in a tile are sent there whole and checked.
    """
    side = F.greatest(F.lit(8), F.least(F.lit(TILE), F.lit(GRAMS) / F.col("widest"))).cast("int")
    tiles = F.ceil(F.col("many") / side).cast("int")
    mine = F.pmod(F.xxhash64("address"), tiles).cast("int")
    keys = ["sign", "i", "j"]
    dealt = (
        groups.join(held.select("address", "node", "size", "bits"), "address")
        .withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), tiles - 1))})
        .select("sign", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "address", "node", "label", "size", "bits")
    )

    def pairs(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size, mine, i, j = (tile.column(c).to_numpy() for c in ("size", "mine", "i", "j"))
        label = tile.column("label").combine_chunks().dictionary_encode().indices.to_numpy()  # ids of any type
        bits = tile.column("bits").to_pylist()
        return label, *_possible(_folded(bits, min(map(len, bits))), size, label, mine, i[0], j[0], like)

    left = ["sign", "i", "j", "mine", "address", "node", "label"]

    def partnered(tile: pa.Table) -> pa.Table:
        _, first, second, _ = pairs(tile)
        return tile.select(left).take(pa.array(np.union1d(first, second).astype(np.int64)))

    kept = T.StructType([dealt.schema[c] for c in left])
    sorted_in = lambda rows: rows.repartition(*keys).sortWithinPartitions(*keys)
    asked = cut(sorted_in(dealt).mapInArrow(lambda batches: _by_tile(batches, keys, partnered), kept))

    kind = T.StructType().add("a", held.schema["node"].dataType).add("b", held.schema["node"].dataType)

    def compared(tile: pa.Table) -> pa.Table:
        label, first, second, apart = pairs(tile)
        order = np.argsort(apart, kind="stable")  # the likeliest first
        first, second = first[order], second[order]
        grams = tile.column("grams").to_pylist()
        told = _forest(label, first, second, lambda a, b: similar(_unpacked(grams[a]), _unpacked(grams[b]), like))
        node = tile.column("node").combine_chunks()
        return pa.Table.from_arrays([node.take(pa.array(first[told], pa.int64())), node.take(pa.array(second[told], pa.int64()))], names=["a", "b"])

    whole = asked.join(held, ["address", "node"])
    return sorted_in(whole).mapInArrow(lambda batches: _by_tile(batches, keys, compared), kind).distinct()


def component_ids(docs: DataFrame, n: int = N, like: Fraction = LIKE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): one for each row of ``docs``."""
    bands = Bands(like)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sets = cut(sets_of(docs, n))
    known = sets.where("n_shingles > 0 and doc_id is not null")
    nodes = cut(known.groupBy("address", "name").agg(F.min("doc_id").alias("node")))
    groups = cut(candidates(docs.where("doc_id is not null"), n, bands))
    wanted = nodes.join(groups.select("address").distinct(), "address", "left_semi")
    held = cut(_sets(docs, wanted, n))
    # Two sets of one address go by the smaller node.
    place = held.groupBy("address").agg(F.min("node").alias("node"), F.min("size").alias("low"), F.max("size").alias("high"))

    # Rows of one id with different sets link those sets.
    whose = known.join(nodes, ["address", "name"])
    links = cut(whose.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b"))
    labels = components(links)

    def labelled() -> DataFrame:
        at = place.join(labels, "node", "left").select("address", F.coalesce("label", "node").alias("label"), "low", "high")
        return groups.join(at, "address")

    for turn in range(ROUNDS):
        fresh = cut(_checked(cut(_led(labelled(), turn, like)), held, like))
        if fresh.isEmpty():
            break
        links = links.unionByName(fresh)
        labels = components(links)
    rest = cut(_split(labelled()))
    last = cut(_tiled(rest, held, like))
    labels = components(links.unionByName(last))

    found = nodes.join(labels, "node", "left").select("address", "name", F.coalesce("label", "node").alias("_component"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("_component")), F.col("doc_id")))
    return sets.join(found, ["address", "name"], "left").select("doc_id", "n_shingles", own.alias("component_id"))


def sql(n: int = N, up: int = LIKE.numerator, down: int = LIKE.denominator, table: str = "documents") -> str:
    """The registered query in DuckDB, by counting common n-grams of all pairs."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE said AS MATERIALIZED (SELECT doc_id, {words} AS w FROM {table}),
grams AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END) AS g FROM said),
flat AS MATERIALIZED (SELECT doc_id, unnest(g) AS gram FROM grams),
shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM flat a JOIN flat b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN grams x ON x.doc_id = a JOIN grams y ON y.doc_id = b
  WHERE {down} * common >= {up} * (len(x.g) + len(y.g) - common)),
twoway AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(node, seen) AS (SELECT a, b FROM twoway UNION SELECT node, b FROM walk JOIN twoway ON a = seen)
SELECT doc_id, len(g) AS n_shingles, least(doc_id, coalesce(least_seen, doc_id)) AS component_id
FROM grams LEFT JOIN (SELECT node, min(seen) AS least_seen FROM walk GROUP BY node) ON node = doc_id"""

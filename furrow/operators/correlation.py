"""Correlation between all taxa of a sparse count table.

The products of every pair of taxa are a matrix product. It is computed in
tiles: taxa are numbered and cut into blocks, samples are hashed into slices,
and each task multiplies one slice of two blocks with NumPy. Cells go to their
tiles one by one: lists of a sample's cells would be built twice and sorted
each time. A hot sample is spread over the blocks and a hot taxon over the
slices, so every task has bounded work. Cells that are absent count as zero.

Where only strong pairs are asked for, a tile decides in its task. With one
slice it knows the correlation. With several, the correlation is a sum over
slices, each term at most the product of the two taxa's norms on that slice
(Cauchy-Schwarz), and these products add up to one at most: so a pair that
reaches the threshold reaches it on some slice, relative to its norms there.
Tiles name such pairs only, and a second pass sums the products of these.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import attach, attach_measured
from ..lineage import cut, cut_measured
from .order import number_rows, running_totals

# A tile's products take 32 MB; a cell is sent once for every block, so blocks are wide.
BLOCK_TAXA = 2_048
SLICE_SAMPLES = 131_072
TILE_CELLS = 2_000_000
# Samples held densely at a time: 16 MB per block of 2,048 taxa.
DENSE_SAMPLES = 1_024
# Rows of one value that a task may join.
HOT_ROWS = 500_000
# What a bound may lose to rounding.
SLACK = 1e-7


def _gathered(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """A tile's cells as one row per sample and block (columns, values), and its facts as one per block (sums, squares)."""
    fact = rows["fact"].to_numpy(bool)
    facts, cells = rows[fact].sort_values("id"), rows[~fact]
    sample, ids = pd.factorize(cells["sample"])[0], cells["id"].to_numpy()
    order = np.lexsort((ids, sample))
    order = order[sample[order] >= 0]
    sample, ids, values = sample[order], ids[order], cells["n"].to_numpy()[order]
    first = np.flatnonzero(np.diff(sample, prepend=-1) | np.diff(ids // width, prepend=-1))
    out = pd.DataFrame({"sample": sample[first], "block": ids[first] // width, "columns": None, "values": None})
    out["columns"] = pd.Series(np.split(ids % width, first[1:]) if len(first) else [], out.index, object)
    out["values"] = pd.Series(np.split(values, first[1:]) if len(first) else [], out.index, object)
    blocks = [(b, rows["n"].to_numpy(), rows["q"].to_numpy()) for b, rows in facts.groupby(facts["id"] // width)]
    return pd.concat([out, pd.DataFrame(blocks, columns=["block", "sums", "squares"])], ignore_index=True)


def _in_tiles(multiply, width: int, paired: bool = False):
    """A task function of gathered rows (and of pairs) as one of a tile's cells and facts."""
    if paired:
        return lambda key, rows, pairs: multiply(key, _gathered(rows, width), pairs)
    return lambda key, rows: multiply(key, _gathered(rows, width))


class _Tile:
    """One slice of two blocks: products of their taxa, and each taxon's sums of values and squares there."""

    def __init__(self, rows: pd.DataFrame, left: int, right: int, n_taxa: int, width: int):
        sample = pd.factorize(rows["sample"])[0]
        block, columns, values = (rows[c].to_numpy() for c in ("block", "columns", "values"))
        sizes = {b: min(width, n_taxa - b * width) for b in (left, right)}

        def dense(b: int, start: int) -> np.ndarray:
            """Cells of one block for the samples from ``start`` on."""
            mine = np.flatnonzero((block == b) & (sample >= start) & (sample < start + DENSE_SAMPLES))
            cells = np.zeros((min(DENSE_SAMPLES, sample.max() + 1 - start), sizes[b]))
            if len(mine):
                at = np.repeat(sample[mine] - start, [len(c) for c in columns[mine]])
                cells[at, np.concatenate(columns[mine])] = np.concatenate(values[mine])
            return cells

        self.products = np.zeros((sizes[left], sizes[right]))
        self.sums = [np.zeros((2, sizes[b])) for b in (left, right)]
        for start in range(0, sample.max(initial=-1) + 1, DENSE_SAMPLES):
            first = dense(left, start)
            second = first if left == right else dense(right, start)
            self.products += first.T @ second
            for held, cells in zip(self.sums, (first, second)):
                held += cells.sum(0), (cells * cells).sum(0)


def _tile_products(n_taxa: int, width: int):
    """Task function: sums of products of the taxa of two blocks over one slice of samples."""

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        piece, left, right = (int(k) for k in key)
        products = _Tile(rows[rows["columns"].notna()], left, right, n_taxa, width).products
        # Slice 0 lists every pair; elsewhere only pairs that meet matter.
        wanted = np.full(products.shape, True) if piece == 0 else products != 0
        if left == right:
            wanted = np.triu(wanted, 1)
        i, j = np.nonzero(wanted)
        return pd.DataFrame({"i": i + left * width, "j": j + right * width, "products": products[i, j]})

    return multiply


def _block_facts(rows: pd.DataFrame, left: int, right: int) -> list[np.ndarray]:
    """Sums of values and squares over all samples, of the taxa of both blocks."""
    facts = rows[rows["sums"].notna()].drop_duplicates("block").set_index("block")
    return [np.array([facts.at[b, "sums"], facts.at[b, "squares"]]) for b in (left, right)]


def _tile_candidates(n_taxa: int, width: int, n_samples: int, in_slice: dict[int, int], threshold: float):
    """Task function: pairs of two blocks that reach the threshold on one slice, relative to their norms there.

    The bound errs by rounding only, which ``SLACK`` covers. With one slice the pair's correlation is told as well.
    """

    def pick(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        piece, left, right = (int(k) for k in key)
        facts = _block_facts(rows, left, right)
        tile = _Tile(rows[rows["columns"].notna()], left, right, n_taxa, width)
        mean = [all_sums / n_samples for all_sums, _ in facts]
        n = in_slice.get(piece, 0)
        centred = np.outer(mean[0], n * mean[1] - tile.sums[1][0])
        centred -= np.outer(tile.sums[0][0], mean[1])
        centred += tile.products
        norm = [np.sqrt(np.maximum(q - 2 * m * s + n * m * m, 0)) for m, (s, q) in zip(mean, tile.sums)]
        reached = np.abs(centred, out=centred) >= (threshold - SLACK) * np.outer(*norm)
        if len(in_slice) == 1:
            r = _pearson(n_samples, tile.products, facts[0][:, :, None], facts[1][:, None, :])
            reached = np.abs(r) >= threshold - SLACK
        if left == right:
            reached = np.triu(reached, 1)
        i, j = np.nonzero(reached)
        out = pd.DataFrame({"left": left, "right": right, "i": i + left * width, "j": j + right * width})
        return out.assign(r=r[i, j] if len(in_slice) == 1 else np.nan)

    return pick


def _pearson(n: int, products, first, second):
    """Correlation from products and both sides' sums of values and squares."""
    (s1, q1), (s2, q2) = first, second
    return (n * products - s1 * s2) / (np.sqrt(n * q1 - s1 * s1) * np.sqrt(n * q2 - s2 * s2))


def _tile_chosen(n_taxa: int, width: int):
    """Task function: products over one slice of the pairs that were picked."""

    def multiply(key: tuple, rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        _, left, right = (int(k) for k in key)
        if not len(pairs):
            return pd.DataFrame({"i": [], "j": [], "products": []}).astype({"i": int, "j": int})
        tile = _Tile(rows[rows["columns"].notna()], left, right, n_taxa, width)
        i, j = pairs["i"].to_numpy(), pairs["j"].to_numpy()
        return pd.DataFrame({"i": i, "j": j, "products": tile.products[i - left * width, j - right * width]})

    return multiply


def taxon_sums(cells: DataFrame, n_samples: int) -> DataFrame:
    """Per taxon ``(s, q, constant)``: sum, sum of squares, and whether all samples agree."""
    absent = F.when(F.count("*") < n_samples, F.lit(0.0))
    return cells.groupBy("taxon").agg(
        F.sum("n").alias("s"),
        F.sum(F.col("n") * F.col("n")).alias("q"),
        (F.least(F.min("n"), absent) == F.greatest(F.max("n"), absent)).alias("constant"),
    )


def centred_ranks(cells: DataFrame, n_samples: int) -> DataFrame:
    """Average rank of every distinct value of a taxon: ``(taxon, n, ties, rank)``.

    Ranks are moved so that an absent cell (a zero) ranks 0, which correlation
    does not see. They come from the counts of distinct values, so a large
    taxon is never sorted in one task.
    """
    values = cells.filter(F.col("n") != 0).groupBy("taxon", "n").agg(F.count("*").alias("ties"))
    ranked = running_totals(values, ["taxon"], [F.col("n").asc()], {"_below": F.col("ties")}, inclusive=False)
    sides = values.groupBy("taxon").agg(
        F.sum("ties").alias("_all"),
        F.coalesce(F.sum(F.when(F.col("n") < 0, F.col("ties"))), F.lit(0)).alias("_neg"),
    )
    zeros = F.lit(n_samples) - F.col("_all")
    zero_rank = F.col("_neg") + (zeros + 1) / 2
    rank = F.col("_below") + (F.col("ties") + 1) / 2 + F.when(F.col("n") > 0, zeros).otherwise(0) - zero_rank
    return attach_measured(ranked, sides, ["taxon"], ["n"]).select("taxon", "n", "ties", rank.alias("rank"))


def _ranked_cells(cells: DataFrame, ranks: DataFrame) -> DataFrame:
    """Cells with their value's rank; a frequent value is spread as far as it asks for."""
    most = ranks.agg(F.max("ties")).first()[0] or 1
    ways = max(1, math.ceil(most / HOT_ROWS))
    found = attach(cells.filter(F.col("n") != 0), ranks.drop("ties"), ["taxon", "n"], ["sample"], ways)
    return found.select("sample", "taxon", F.col("rank").alias("n"))


def _numbered(facts: DataFrame) -> tuple[DataFrame, int]:
    """Facts per taxon with ``id`` from 0 in name order, and their number."""
    rows, seen = cut_measured(number_rows(facts, (), [F.col("taxon").asc()]), n=F.count("*"))
    return rows.withColumn("id", (F.col("rn") - 1).cast("int")).drop("rn"), seen["n"]


@dataclass
class _Packed:
    """Cells in tiles: ``rows`` ``(slice, left, right, sample, id, n, q, fact)``, dealt to all tiles of their block."""

    rows: DataFrame
    taxa: DataFrame
    n_taxa: int
    n_samples: int
    slices: int
    blocks: int
    in_slice: DataFrame


def _packed(counts: DataFrame, method: str, stored: bool) -> _Packed:
    if method not in ("spearman", "pearson"):
        raise ValueError("method is 'spearman' or 'pearson'")
    spark = counts.sparkSession
    cells = counts.select("sample", F.col("taxon").cast("string").alias("taxon"), F.col("n").cast("double").alias("n"))
    cells = cells if stored else cut(cells)
    samples, seen = cut_measured(cells.select("sample").distinct(), n=F.count("sample"))
    n_samples, n_cells = seen["n"], cells.count()
    facts = taxon_sums(cells, n_samples).filter(~F.col("constant")).drop("constant")
    if method == "spearman":
        ranks = cut(centred_ranks(cells, n_samples))
        values = _ranked_cells(cells, ranks)
        sums = ranks.groupBy("taxon").agg(
            F.sum(F.col("ties") * F.col("rank")).alias("s"), F.sum(F.col("ties") * F.col("rank") ** 2).alias("q")
        )
        facts = sums.join(facts.select("taxon"), "taxon", "left_semi")
    else:
        values = cells.filter(F.col("n") != 0)
    taxa, n_taxa = _numbered(facts)
    blocks = max(1, math.ceil(n_taxa / BLOCK_TAXA))
    slices = max(1, math.ceil(n_samples / SLICE_SAMPLES), math.ceil(2 * n_cells / (blocks * TILE_CELLS)))
    slice_of = F.pmod(F.xxhash64("sample"), F.lit(slices)).cast("int")

    # A row of facts per taxon and slice, so that all tiles exist and know their taxa's sums.
    numbered = attach_measured(values, taxa.select("taxon", "id"), ["taxon"], ["sample"], stored=True)
    held = numbered.select(slice_of.alias("slice"), "sample", "id", "n", F.lit(0.0).alias("q"), F.lit(False).alias("fact"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    facts = taxa.select(every, "id", F.col("s").alias("n"), "q", F.lit(True).alias("fact"))
    block = F.floor(F.col("id") / BLOCK_TAXA).cast("int")
    rows = (
        held.unionByName(facts, allowMissingColumns=True)
        .withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumns({"left": F.least(block, "_with"), "right": F.greatest(block, "_with")})
        .drop("_with")
    )
    in_slice = samples.groupBy(slice_of.alias("slice")).agg(F.count("sample").alias("n"))
    return _Packed(rows, taxa, n_taxa, n_samples, slices, blocks, in_slice)


def _with_facts(pairs: DataFrame, taxa: DataFrame, *columns: str) -> DataFrame:
    for side, other, suffix in (("i", "j", "1"), ("j", "i", "2")):
        facts = taxa.select(F.col("id").alias(side), *[F.col(c).alias(c + suffix) for c in columns])
        pairs = attach_measured(pairs, facts, [side], [other], stored=True)
    return pairs


def _correlation(pairs: DataFrame, n_samples: int) -> Column:
    n = F.lit(float(n_samples))
    spread = F.sqrt(n * F.col("q1") - F.col("s1") * F.col("s1")) * F.sqrt(n * F.col("q2") - F.col("s2") * F.col("s2"))
    return F.coalesce(F.try_divide(n * F.col("p") - F.col("s1") * F.col("s2"), spread), F.lit(0.0))


def correlations(counts: DataFrame, method: str = "spearman", stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Correlation of every pair of non-constant taxa, and those taxa.

    ``counts`` has one row per ``(sample, taxon)`` with value ``n``; ``stored``
    tells that it reads a table and need not be stored first. Returns
    ``(t1, t2, r)`` with ``t1 < t2``, and ``(taxon)``.
    """
    held = _packed(counts, method, stored)
    multiply = _in_tiles(_tile_products(held.n_taxa, BLOCK_TAXA), BLOCK_TAXA)
    tiles = held.rows.groupBy("slice", "left", "right").applyInPandas(multiply, "i int, j int, products double")
    pairs = _with_facts(tiles.groupBy("i", "j").agg(F.sum("products").alias("p")), held.taxa, "taxon", "s", "q")
    r = _correlation(pairs, held.n_samples)
    return pairs.select(F.col("taxon1").alias("t1"), F.col("taxon2").alias("t2"), r.alias("r")), held.taxa.select("taxon")


def strong_pairs(
    counts: DataFrame, method: str = "spearman", keep_thresh: float = 0.5, stored: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The edges of :func:`strong_edges` over :func:`correlations`, and the taxa, without listing the other pairs.

    Tiles name candidates only: with one slice of samples these are the edges.
    """
    held = _packed(counts, method, stored)
    in_slice = {0: held.n_samples}
    if held.slices > 1:
        in_slice = {int(r["slice"]): int(r["n"]) for r in held.in_slice.collect()}  # a number for each slice
        in_slice |= {k: 0 for k in range(held.slices) if k not in in_slice}
    pick = _in_tiles(_tile_candidates(held.n_taxa, BLOCK_TAXA, held.n_samples, in_slice, keep_thresh), BLOCK_TAXA)
    tile = ["slice", "left", "right"]
    found = held.rows.groupBy(*tile).applyInPandas(pick, "left int, right int, i int, j int, r double")
    if held.slices > 1:
        found = cut(found.drop("r").distinct())
        rows = held.rows.join(found.select("left", "right").distinct(), ["left", "right"], "left_semi")
        asked = found.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(held.slices - 1))))
        multiply = _in_tiles(_tile_chosen(held.n_taxa, BLOCK_TAXA), BLOCK_TAXA, paired=True)
        chosen = rows.groupBy(*tile).cogroup(asked.groupBy(*tile)).applyInPandas(multiply, "i int, j int, products double")
        pairs = _with_facts(chosen.groupBy("i", "j").agg(F.sum("products").alias("p")), held.taxa, "taxon", "s", "q")
        pairs = pairs.withColumn("r", _correlation(pairs, held.n_samples))
    else:
        pairs = _with_facts(found.select("i", "j", "r"), held.taxa, "taxon")
    named = pairs.select(F.col("taxon1").alias("t1"), F.col("taxon2").alias("t2"), "r")
    return strong_edges(named, keep_thresh), held.taxa.select("taxon")


def strong_edges(pairs: DataFrame, keep_thresh: float = 0.5) -> DataFrame:
    """Edges ``(src, dst, weight)`` of pairs whose absolute correlation reaches the threshold.

    Compared after rounding to nine places, so the last bits of a sum do not
    decide about an edge.
    """
    weight = F.round(F.abs("r"), 9)
    return pairs.select(F.col("t1").alias("src"), F.col("t2").alias("dst"), weight.alias("weight")).filter(
        (F.col("weight") >= keep_thresh) & (F.col("weight") > 0)
    )


def melt_matrix(matrix: DataFrame, label: str = "var1") -> DataFrame:
    """Square wide matrix to the edge list ``(var1, var2, edge)`` of its positive entries."""
    others = [c for c in matrix.columns if c != label]
    return matrix.unpivot(label, others, "var2", "edge").filter(F.col("edge") > 0)

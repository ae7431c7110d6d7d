"""256-bin histograms per image: counting, averaging, alignment and shares.

Long form is ``(keys..., bin, n)``. Packed form is one row per image with
``hist array<bigint>`` of length 256; whole frames produce it directly.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import attach, attach_measured, match
from .naming import image_order

BINS = 256
# An image has fewer than 2**24 pixels a bin, and 256 bins are summed: 21 + 24 + 8 = 53 bits.
LIMB = 21
# Images correlated at a time: 12 MB of products.
LAG_IMAGES = 1_024


def count_bins(rows: DataFrame, keys: Sequence[str], bin_col: str = "bin") -> DataFrame:
    """Long histogram of rows that carry a bin in 0..255."""
    return rows.groupBy(*keys, F.col(bin_col).alias("bin")).agg(F.count("*").alias("n"))


def clamped(level: Column) -> Column:
    """A level as a bin: those outside 0..255 count in the nearest one."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), level)).cast("int")


def _scattered(bins: pd.Series, counts: pd.Series) -> pd.Series:
    """Packed histograms from lists of bins and their counts."""
    sizes = np.fromiter(map(len, bins), np.int64, len(bins))
    packed = np.zeros((len(bins), BINS), np.int64)
    if sizes.sum():
        row = np.repeat(np.arange(len(bins)), sizes)
        np.add.at(packed, (row, np.concatenate(bins.to_numpy())), np.concatenate(counts.to_numpy()))
    return pd.Series(list(packed))


def pack(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long to packed form; bins outside 0..255 count in the nearest one, so a list holds at most 256 entries."""
    scatter = F.pandas_udf(_scattered, "array<bigint>")
    per_bin = hist.groupBy(*keys, clamped(F.col("bin")).alias("bin")).agg(F.sum("n").cast("long").alias("n"))
    lists = per_bin.groupBy(*keys).agg(F.collect_list(F.struct("bin", "n")).alias("_counts"))
    return lists.select(*keys, scatter("_counts.bin", "_counts.n").alias("hist"))


def mean_of_bins(hist: DataFrame, image: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean count per bin over all images of a group, from the long form: ``(by..., bin, mean_n)`` with all 256 bins."""
    totals = hist.groupBy(*by, clamped(F.col("bin")).alias("bin")).agg(F.sum("n").alias("n"))
    images = hist.select(*by, *image).distinct().groupBy(*by).agg(F.count("*").alias("_images"))
    bins = images.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    mean = F.coalesce(F.col("n"), F.lit(0)) / F.col("_images")
    return match(bins, totals, [*by, "bin"], "left").select(*by, "bin", mean.alias("mean_n"))


def image_sizes(hist: DataFrame, image: Sequence[str]) -> DataFrame:
    """Largest bin and number of pixels per image, from the long form: ``(image..., largest, n_pixels)``."""
    return hist.groupBy(*image).agg(F.max("n").alias("largest"), F.sum("n").alias("n_pixels"))


def unpack(packed: DataFrame, column: str = "hist", name: str = "n") -> DataFrame:
    """Packed to long form, zero bins included."""
    rest = [c for c in packed.columns if c != column]
    return packed.select(*rest, F.posexplode(column).alias("bin", name))


def mean_histogram(packed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean count per bin over all images of a group, as ``(by..., bin, mean_n)``."""
    return unpack(packed.select(*by, "hist")).groupBy(*by, "bin").agg(F.avg("n").alias("mean_n"))


def mean_references(packed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean histogram times the image count, one ``(by..., ref, base)`` row per group.

    The position of the correlation peak ignores a positive factor, and whole
    numbers, multiplied exactly, keep ties.
    """
    sums = unpack(packed.select(*by, "hist")).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    return pack(sums, by).select(*by, F.col("hist").alias("ref"), F.lit(0).alias("base"))


def first_references(packed: DataFrame, by: Sequence[str] = (), image: str = "image_id") -> DataFrame:
    """Histogram of the first image by number, based on its own shift against the mean."""
    first = packed.groupBy(*by).agg(F.min_by("hist", image_order(image)).alias("ref"))
    means = mean_references(packed, by).select(*by, F.col("ref").alias("mean"))
    peak_lag = F.pandas_udf(_peak_lag, "int")
    both = attach(first, means, by, ["ref"])
    return both.select(*by, "ref", peak_lag("ref", "mean").alias("base"))


def _peak_lag(hist: pd.Series, ref: pd.Series) -> pd.Series:
    """Lag with the largest cross-correlation; the smallest such lag on ties. Some images of a batch at a time."""
    starts = range(0, len(hist), LAG_IMAGES)
    parts = [_peak_lags(hist.iloc[i : i + LAG_IMAGES], ref.iloc[i : i + LAG_IMAGES]) for i in starts]
    return pd.Series(np.concatenate([np.empty(0, np.int32), *parts]))


def _peak_lags(hist: pd.Series, ref: pd.Series) -> np.ndarray:
    lags = np.arange(1 - BINS, BINS)
    source = np.arange(BINS)[:, None] - lags[None, :]
    valid = (source >= 0) & (source < BINS)
    images = np.stack(hist.to_numpy()).astype(np.float64)
    out = np.empty(len(images), dtype=np.int32)
    refs = pd.Series([r.tobytes() for r in ref])
    for rows in refs.groupby(refs).indices.values():
        reference = np.asarray(ref.iloc[rows[0]], dtype=np.int64)
        shifted = np.where(valid, reference[np.where(valid, source, 0)], 0)
        # Limbs of the reference keep every floating-point product and sum a whole number below 2**53.
        limbs = [((shifted >> (LIMB * i)) & ((1 << LIMB) - 1)).astype(np.float64) for i in range(-(-63 // LIMB))]
        out[rows] = lags[_largest([(images[rows] @ limb).astype(np.int64) for limb in limbs])]
    return out


def _largest(limbs: list[np.ndarray]) -> np.ndarray:
    """Column of the largest number in each row, the first on ties; numbers are given in limbs, the lowest first."""
    for i in range(len(limbs) - 1):  # carry, so that limbs compare one by one
        limbs[i + 1] = limbs[i + 1] + (limbs[i] >> LIMB)
        limbs[i] = limbs[i] & ((1 << LIMB) - 1)
    able = np.ones(limbs[0].shape, bool)
    for limb in reversed(limbs):
        most = np.where(able, limb, -1).max(axis=1, keepdims=True)
        able &= limb == most
    return able.argmax(axis=1)


def with_shift(packed: DataFrame, refs: DataFrame, by: Sequence[str] = (), image: str = "image_id") -> DataFrame:
    """Add each image's signed ``shift``: its lag against the group's reference plus the reference's base."""
    peak_lag = F.pandas_udf(_peak_lag, "int")
    paired = attach_measured(packed, refs, by, [image])
    return paired.withColumn("shift", peak_lag("hist", "ref") + F.col("base")).drop("ref", "base")


def with_shift_to_mean(packed: DataFrame, by: Sequence[str] = (), image: str = "image_id") -> DataFrame:
    """Shift of every image against the mean histogram of its group."""
    return with_shift(packed, mean_references(packed, by), by, image)


def with_shift_to_first(packed: DataFrame, by: Sequence[str] = (), image: str = "image_id") -> DataFrame:
    """Shift against the first image plus that image's own shift against the mean."""
    return with_shift(packed, first_references(packed, by, image), by, image)


def rolled(hist: Column, shift: Column) -> Column:
    """Circular roll of a packed histogram by ``-shift``."""
    start = F.pmod(shift, F.lit(BINS))
    return F.concat(F.slice(hist, start + 1, F.lit(BINS) - start), F.slice(hist, F.lit(1), start))


def aligned_mean(packed_with_shift: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean histogram after rolling every image back by its shift."""
    aligned = packed_with_shift.select(*by, rolled(F.col("hist"), F.col("shift")).alias("hist"))
    return mean_histogram(aligned, by)


def total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda a, n: a + n)


def range_share(hist: Column, shift: Column, lower: int, upper: int, n_plot: Column) -> Column:
    """Share of plot pixels in bins ``lower+shift .. upper+shift``, clamped to 0..255."""
    lo = F.greatest(F.lit(0), F.lit(lower) + shift)
    hi = F.least(F.lit(BINS - 1), F.lit(upper) + shift)
    picked = F.slice(hist, F.least(lo, F.lit(BINS)) + 1, F.greatest(hi - lo + 1, F.lit(0)))
    return F.when(n_plot > 0, total(picked) / n_plot)


def largest_bin(hist: Column) -> Column:
    return F.array_max(hist)


def too_full(largest: Column, frame_pixels: Column, share: float = 0.2) -> Column:
    return largest >= frame_pixels * share


def is_bad_frame(hist: Column, frame_pixels: Column, share: float = 0.2) -> Column:
    """One gray level fills at least ``share`` of the frame."""
    return too_full(largest_bin(hist), frame_pixels, share)

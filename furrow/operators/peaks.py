"""Bright-spot counting: local maxima of the highlight image.

A spot is a pixel above the threshold that exceeds its 8 neighbours; among
equal neighbours the one first in row order counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.highlight import linear_array, logistic_array
from ..joins import match

STEPS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def local_peaks(pixels: DataFrame, image: str = "image_id", value: str = "v", threshold: float = 0.0) -> DataFrame:
    """Peaks ``(image, y, x, score)`` of pixel rows ``(image, y, x, value)``.

    Each pixel reports its value to the nine cells around it. Reports meet by
    cell, mostly before the shuffle already, so no pair of pixels is formed.
    """
    candidates = pixels.filter(F.col(value) > threshold)
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in STEPS])
    standing = F.struct(F.col(value).alias("v"), (-F.col("y")).alias("up"), (-F.col("x")).alias("left"))
    reports = candidates.select(image, "y", "x", standing.alias("s"), F.explode(steps).alias("d")).select(
        image,
        (F.col("y") + F.col("d.dy")).alias("y"),
        (F.col("x") + F.col("d.dx")).alias("x"),
        F.when((F.col("d.dy") == 0) & (F.col("d.dx") == 0), F.col("s")).alias("own"),
        F.col("s"),
    )
    cells = reports.groupBy(image, "y", "x").agg(F.max("own").alias("own"), F.max("s").alias("best"))
    return cells.filter(F.col("own") == F.col("best")).select(image, "y", "x", F.col("own.v").alias("score"))


def count_per_image(peaks: DataFrame, images: DataFrame, image: str = "image_id") -> DataFrame:
    """Spot count of every image, zero where there is none."""
    counts = peaks.groupBy(image).agg(F.count("*").alias("n_spots"))
    joined = match(images.select(image), counts, [image], "left")
    return joined.select(image, F.coalesce("n_spots", F.lit(0)).alias("n_spots"))


def peak_count_array(v: np.ndarray, threshold: float) -> int:
    """The same count on one highlight image held as an array."""
    height, width = v.shape
    padded = np.pad(v, 1, constant_values=-np.inf)
    peak = v > threshold
    for dy, dx in STEPS:
        if (dy, dx) == (0, 0):
            continue
        near = padded[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width]
        peak &= (v >= near) if (dy, dx) > (0, 0) else (v > near)
    return int(peak.sum())


def spots_of_area(
    area: Column, shift: Column, mask: np.ndarray, lower: int, mode: str, distance: int, out_value: float, threshold: float
) -> Column:
    """Spot count of the stored flower-area crop of an image (b levels, one byte each)."""

    @F.pandas_udf("int")
    def count(crop: pd.Series, by: pd.Series) -> pd.Series:
        found = np.zeros(len(crop), dtype=np.int32)
        for i, (data, s) in enumerate(zip(crop, by)):
            b = np.frombuffer(data, dtype=np.uint8).reshape(mask.shape).astype(np.float64)
            if mode == "linear":
                v = linear_array(b, int(s), lower)
            else:
                v = logistic_array(b, int(s), lower, distance, out_value)
            found[i] = peak_count_array(np.where(mask, v, 0.0), threshold)
        return pd.Series(found)

    return count(area, shift)


def masked_pixels(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Keep the pixels listed in a mask table of one frame (at most one row per pixel position)."""
    return pixels.join(mask.select("y", "x"), ["y", "x"], "left_semi")


def spot_images(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """All images that have pixel rows."""
    return pixels.select(image).distinct()


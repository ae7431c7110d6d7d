"""Plot geometry. The point tests take columns or NumPy arrays alike."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import check_bounds, check_regions


def side_lines(bounds) -> np.ndarray:
    """One row (a, b, c) per side of a plot: ``a x + b y + c`` is positive on the side's inner half of the plane.

    A side runs between two corners; it is turned so that the inner half is the
    one to the right of the left side, left of the right side, below the top
    side and above the bottom side of an upright plot.
    """
    check_bounds(bounds)
    corner = {name: np.array([int(px), int(py), 1]) for name, (px, py) in zip(("tl", "tr", "bl", "br"), bounds)}
    # A line through two points is the cross product of their homogeneous coordinates.
    return np.array([np.cross(corner[p], corner[q]) for p, q in (("bl", "tl"), ("tr", "br"), ("tl", "tr"), ("br", "bl"))])


def inside_quad(x, y, bounds, height: int, width: int):
    """True strictly inside the four sides of ``bounds`` and within the frame."""
    corners = np.array([(int(px), int(py)) for px, py in bounds])
    low = np.maximum(corners.min(axis=0), 0)
    high = np.minimum(corners.max(axis=0), [width, height])
    box = [(x >= int(low[0])), (x < int(high[0])), (y >= int(low[1])), (y < int(high[1]))]
    sides = [(int(a) * x + int(b) * y + int(c) > 0) for a, b, c in side_lines(bounds)]
    return reduce(lambda one, other: one & other, box + sides)


def homography(source, target) -> np.ndarray:
    """The 3x3 perspective transform taking four source points to four targets."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows.append([x, y, 1, 0, 0, 0, -u * x, -u * y])
        rows.append([0, 0, 0, x, y, 1, -v * x, -v * y])
        right += [u, v]
    solved = np.linalg.solve(np.array(rows, dtype=float), np.array(right, dtype=float))
    return np.append(solved, 1.0).reshape(3, 3)


def region_cells(regions, bounds) -> list[tuple[tuple[int, int], ...]]:
    """Pixel corners of every marked grid cell, laid onto the plot in perspective.

    All grid corners are placed at once; they pass through single precision
    before truncation, as the expected pixel counts assume.
    """
    check_regions(regions)
    marked = np.asarray(regions)
    n_rows, n_cols = marked.shape
    matrix = homography([(0, 0), (n_cols, 0), (0, n_rows), (n_cols, n_rows)], bounds)
    ys, xs = np.mgrid[0 : n_rows + 1, 0 : n_cols + 1]
    placed = np.stack([xs, ys, np.ones_like(xs)], axis=-1) @ matrix.T
    corners = (placed[..., :2] / placed[..., 2:]).astype(np.float32).astype(int)
    return [
        tuple(tuple(int(v) for v in corners[row + down, col + right]) for down in (0, 1) for right in (0, 1))
        for row, col in np.argwhere(marked == 1)
    ]


def inside_regions(x, y, regions, bounds, height: int, width: int):
    """True inside any marked cell of the region grid."""
    cells = region_cells(regions, bounds)
    if not cells:
        return x != x
    return reduce(lambda a, b: a | b, [inside_quad(x, y, c, height, width) for c in cells])


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """All pixel positions of a frame as ``(y, x)``."""
    return spark.range(height * width).select(
        F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x")
    )


def quad_mask(spark: SparkSession, bounds, height: int, width: int) -> DataFrame:
    """Kept pixels of a quadrilateral plot."""
    return grid(spark, height, width).filter(inside_quad(F.col("x"), F.col("y"), bounds, height, width))


def region_mask(spark: SparkSession, regions, bounds, height: int, width: int) -> DataFrame:
    """Kept pixels of the marked cells: the union of the cell masks."""
    pixels = grid(spark, height, width)
    return pixels.filter(inside_regions(F.col("x"), F.col("y"), regions, bounds, height, width))


def union_masks(*masks: DataFrame) -> DataFrame:
    """Pixels kept by any of the masks, each once."""
    return reduce(DataFrame.unionByName, masks).distinct()


def mask_array(test, height: int, width: int) -> np.ndarray:
    """Boolean frame of a point test, for work on whole frames inside tasks."""
    y, x = np.mgrid[0:height, 0:width]
    return test(x, y)

"""Grouping of images by pooled distances of their descriptors to visual words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import number_rows


def explode_descriptors(records: DataFrame, image: str = "image_id", features: str = "features") -> DataFrame:
    """One row per descriptor; images without descriptors fall away."""
    return records.filter(F.size(features) > 0).select(image, F.posexplode(features).alias("pos", "vec"))


def first_descriptors(records: DataFrame, image: str = "image_id", features: str = "features") -> DataFrame:
    """The first descriptor of every image that has one."""
    return records.filter(F.size(features) > 0).select(image, F.element_at(features, 1).alias("vec"))


def first_vectors(descriptors: DataFrame, image: str = "image_id", order: str = "pos") -> DataFrame:
    """The first descriptor per image from the long form."""
    return descriptors.groupBy(image).agg(F.min_by("vec", order).alias("vec"))


def extract_descriptors(images: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run a user-supplied extractor over Arrow batches of images.

    The extractor yields no row for an image it cannot read.
    """
    return images.mapInPandas(fn, schema)


def tile_descriptors(pixels: DataFrame, image: str = "image_id", value: str = "v", size: int = 8) -> DataFrame:
    """Mean, variance and mean gradients of each ``size`` x ``size`` tile.

    Gradients are the least-squares slopes of the value over x and y, which
    need sums only.
    """
    v, dx, dy = F.col(value), F.col("x") % size, F.col("y") % size
    tiles = pixels.groupBy(
        image, F.floor(F.col("y") / size).alias("tile_y"), F.floor(F.col("x") / size).alias("tile_x")
    ).agg(
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("variance"),
        F.coalesce(F.try_divide(F.covar_pop(dx, v), F.var_pop(dx)), F.lit(0.0)).alias("slope_x"),
        F.coalesce(F.try_divide(F.covar_pop(dy, v), F.var_pop(dy)), F.lit(0.0)).alias("slope_y"),
    )
    return tiles.select(image, "tile_y", "tile_x", F.array("mean", "variance", "slope_x", "slope_y").alias("vec"))


def fit_centres(
    descriptors: DataFrame, k: int = 3, max_iter: int = 5, mode: str = "random", seed: int = 7, vec: str = "vec"
) -> list[list[float]]:
    """K-means centres of all descriptors."""
    points = descriptors.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    points.persist()
    try:
        model = KMeans(k=k, maxIter=max_iter, initMode=mode, seed=seed).fit(points)
    finally:
        points.unpersist()
    return [list(map(float, c)) for c in model.clusterCenters()]


def _means(descriptors: DataFrame, label: str, vec: str = "vec") -> DataFrame:
    """Mean vector of each label."""
    return descriptors.groupBy(label).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))).alias("centre")
    )


def mean_centres(descriptors: DataFrame, label: str, vec: str = "vec") -> list[list[float]]:
    """Given centres: the mean vector of each label, in label order. Centres are parameters of a model, held by the driver."""
    return [list(row["centre"]) for row in _means(descriptors, label, vec).orderBy(label).collect()]


def first_centres(descriptors: DataFrame, k: int, order: str = "pos", vec: str = "vec") -> list[list[float]]:
    """The first ``k`` vectors by a key, to start a fit from."""
    return [[float(x) for x in row[vec]] for row in descriptors.orderBy(order).limit(k).select(vec).collect()]


def settle_centres(
    descriptors: DataFrame, start: Sequence[Sequence[float]], max_iter: int = 5, tol: float = 1e-12, vec: str = "vec"
) -> list[list[float]]:
    """K-means centres from given ones: rounds of nearest centres and their means; an emptied centre stays."""
    centres = [list(map(float, c)) for c in start]
    for _ in range(max_iter):
        words = assign_words(descriptors.select(vec), centres, vec)
        moved = {row["word"]: list(row["centre"]) for row in _means(words, "word", vec).collect()}
        last, centres = centres, [moved.get(j, c) for j, c in enumerate(centres)]
        if max(abs(a - b) for old, new in zip(last, centres) for a, b in zip(old, new)) <= tol:
            break
    return centres


def nearest_centre(vec: Column, centres: Sequence[Sequence[float]]) -> Column:
    """Struct ``(word, dist)``: closest centre, the first on ties, and Euclidean distance."""
    matrix = np.asarray(centres, dtype=np.float64)

    @F.pandas_udf("word int, dist double")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        points = np.stack(vectors.to_numpy()).astype(np.float64)
        squares = np.empty((len(points), len(matrix)))
        for j, centre in enumerate(matrix):
            gap = points - centre
            squares[:, j] = np.einsum("ij,ij->i", gap, gap)
        word = squares.argmin(axis=1)
        dist = np.sqrt(squares[np.arange(len(points)), word])
        return pd.DataFrame({"word": word.astype(np.int32), "dist": dist})

    return assign(vec)


def assign_words(descriptors: DataFrame, centres: Sequence[Sequence[float]], vec: str = "vec") -> DataFrame:
    """Add ``word`` and ``dist`` to every descriptor."""
    return descriptors.withColumn("_near", nearest_centre(F.col(vec), centres)).select(
        *descriptors.columns, F.col("_near.word").alias("word"), F.col("_near.dist").alias("dist")
    )


def pooled_vectors(words: DataFrame, k: int, pooling: str = "max", image: str = "image_id") -> DataFrame:
    """Pooled distance per image and word as ``pooled array<double>`` of length k; zero for unused words.

    ``used`` holds which words occur at all. A list holds at most k entries.
    """
    if pooling not in ("max", "sum"):
        raise ValueError("pooling is 'max' or 'sum'")
    pool = F.max("dist") if pooling == "max" else F.sum("dist")
    per_word = words.groupBy(image, "word").agg(pool.alias("pooled"))
    by_word = per_word.groupBy(image).agg(F.map_from_entries(F.collect_list(F.struct("word", "pooled"))).alias("_m"))
    slots = F.sequence(F.lit(0), F.lit(k - 1))
    return by_word.select(
        image,
        F.transform(slots, lambda j: F.coalesce(F.try_element_at("_m", j), F.lit(0.0))).alias("pooled"),
        F.transform(slots, lambda j: F.try_element_at("_m", j).isNotNull()).alias("used"),
    )


def pooled_rows(pooled: DataFrame, image: str = "image_id") -> DataFrame:
    """Pooled vectors in long form ``(image, word, pooled)``."""
    return pooled.select(image, F.posexplode("pooled").alias("word", "pooled"))


def group_of(pooled: DataFrame, image: str = "image_id", empty: str = "wins") -> DataFrame:
    """Group = 1 + index of the smallest pooled value, first on ties.

    With ``empty="wins"`` an unused word counts as zero and so is chosen;
    ``empty="ignore"`` looks at used words only.
    """
    if empty == "wins":
        values = F.col("pooled")
    elif empty == "ignore":
        values = F.zip_with("pooled", "used", lambda p, u: F.when(u, p).otherwise(F.lit(float("inf"))))
    else:
        raise ValueError("empty is 'wins' or 'ignore'")
    return pooled.select(image, F.array_position(values, F.array_min(values)).cast("int").alias("group"))


def kmeans_labels(
    vectors: DataFrame,
    k: int = 3,
    seed: int = 7,
    max_iter: int = 20,
    image: str = "image_id",
    vec: str = "vec",
    start: Sequence[Sequence[float]] | None = None,
) -> DataFrame:
    """K-means on one vector per image, from given centres or by parallel k-means++; labels count from 1."""
    if start is not None:
        words = assign_words(vectors.select(image, vec), settle_centres(vectors, start, max_iter, vec=vec), vec)
        return words.select(image, (F.col("word") + 1).alias("group"))
    points = vectors.select(image, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    points.persist()
    try:
        model = KMeans(k=k, seed=seed, maxIter=max_iter, initMode="k-means||").fit(points)
    finally:
        points.unpersist()
    return model.transform(points).select(image, (F.col("prediction") + 1).alias("group"))


def group_members(groups: DataFrame, image: str = "image_id", group: str = "group") -> DataFrame:
    """Members of every group in name order as ``(group, position, image)``.

    A group may hold a large part of all images, so it stays rows and is never
    gathered into one list.
    """
    return number_rows(groups.select(group, image), [group], [F.col(image).asc()], "position")

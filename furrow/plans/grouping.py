"""Image grouping by visual words."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import clusters


def group_images(
    descriptors: DataFrame, k: int = 3, pooling: str = "max", max_iter: int = 5, seed: int = 7, empty: str = "wins", start=None
) -> DataFrame:
    """Fit visual words on all descriptors, pool distances per image, pick each image's group.

    ``descriptors`` has rows ``(image_id, pos, vec)``. ``start`` gives the centres to begin with; random ones otherwise.
    """
    if start is None:
        centres = clusters.fit_centres(descriptors, k, max_iter, "random", seed)
    else:
        centres = clusters.settle_centres(descriptors, start, max_iter)
    return group_with_centres(descriptors, centres, pooling, empty)


def group_with_centres(descriptors: DataFrame, centres, pooling: str = "max", empty: str = "wins") -> DataFrame:
    """Groups ``(image_id, group)`` for given centres."""
    words = clusters.assign_words(descriptors, centres)
    return clusters.group_of(clusters.pooled_vectors(words, len(centres), pooling), empty=empty)

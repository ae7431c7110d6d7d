"""Frame series: timestamps, gap filling, smoothing, selection, 1-D clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import attach_measured, match
from ..lineage import cut, cut_measured, discard
from .naming import file_number, image_keys, image_order  # noqa: F401
from .order import BLOCK_ROWS, centred_mean, nearest_known, number_rows

# Ranks that a quantile sketch tells apart; it brackets a rank by four of them.
SKETCH_RANKS = 10_000


def known_images(timestamps: DataFrame, images: DataFrame, image: str = "image_id") -> DataFrame:
    """Timestamps of the images at hand only."""
    return timestamps.join(images.select(image), image, "left_semi")


def fill_timestamps(
    frames: DataFrame, by: Sequence[str] = (), key: str = "image_id", ts: str = "ts", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Missing times become the previous known one plus a minute per frame in between.

    Frames before the first known time stay null.
    """
    numbered = number_rows(frames, by, image_keys(key))
    near = nearest_known(numbered, by, F.col(ts), block_rows=block_rows)
    guess = F.timestamp_add("MINUTE", F.col("rn") - F.col("_prev.rn"), F.col("_prev.value"))
    return near.withColumn(ts, F.coalesce(F.col(ts), guess)).drop("rn", "_prev", "_next")


def number_frames(frames: DataFrame, by: Sequence[str], ts: str = "ts", key: str = "image_id") -> DataFrame:
    """Number frames by time, unknown times first, then by image number."""
    return number_rows(frames, by, [F.col(ts).asc_nulls_first(), *image_keys(key)])


def interpolate(
    numbered: DataFrame, by: Sequence[str], value: Column, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Linear in frame number between known values; flat before the first and after the last."""
    near = nearest_known(numbered, by, value.cast("double"), block_rows=block_rows)
    p, n = F.col("_prev"), F.col("_next")
    inner = p["value"] + (n["value"] - p["value"]) * (F.col("rn") - p["rn"]) / F.nullif(n["rn"] - p["rn"], F.lit(0))
    return near.withColumn(name, F.coalesce(inner, p["value"], n["value"])).drop("_prev", "_next")


def smooth(
    numbered: DataFrame, by: Sequence[str], value: str, name: str, width: int = 60, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Moving mean over rows ``[i - width/2, i + width/2)``, shorter at the ends."""
    half = width // 2
    return centred_mean(numbered, by, value, name, half, half - 1, block_rows=block_rows)


def estimate(
    numbered: DataFrame, by: Sequence[str], value: Column, name: str, width: int = 60, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Gap interpolation followed by smoothing."""
    filled = interpolate(numbered, by, value, "_filled", block_rows)
    return smooth(filled, by, "_filled", name, width, block_rows).drop("_filled")


def group_sizes(frames: DataFrame, by: Sequence[str], name: str = "n_frames") -> DataFrame:
    return frames.groupBy(*by).agg(F.count("*").alias(name))


def _brackets(held: DataFrame, by: Sequence[str], share: float) -> DataFrame:
    """Values ``_low`` and ``_high`` around the last of the lowest ``share`` of ``_v``, and how many are ``_wanted`` from ``_low`` on.

    The sketch only proposes them. The ranks are counted, and a side that proves wrong is opened, so the result is exact.
    """
    near = [max(0.0, share - 2 / SKETCH_RANKS), min(1.0, share + 2 / SKETCH_RANKS)]
    proposed = cut(
        held.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", near, SKETCH_RANKS).alias("_ends"))
        .select(*by, F.floor(F.col("_n") * F.lit(float(share))).alias("_k"), F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"))
    )
    # Combined before the shuffle: a group is one row a task.
    sides = attach_measured(held, proposed, by, by, stored=True).groupBy(*by).agg(
        *(F.any_value(c).alias(c) for c in ("_k", "_low", "_high")),
        F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if(F.col("_v") <= F.col("_high")).alias("_reach"),
    )
    low_holds, high_holds = F.col("_below") < F.col("_k"), F.col("_reach") >= F.col("_k")
    return sides.select(
        *by,
        F.when(low_holds, F.col("_low")).otherwise(F.lit(-math.inf)).alias("_low"),
        F.when(high_holds, F.col("_high")).otherwise(F.lit(math.nan)).alias("_high"),  # sorts above all
        (F.col("_k") - F.when(low_holds, F.col("_below")).otherwise(0)).alias("_wanted"),
    )


def best_frames(
    frames: DataFrame, by: Sequence[str], metric: str, share: float = 0.10, key: str = "image_id", cluster: str | None = None
) -> DataFrame:
    """The ``floor(N * share)`` frames with the lowest metric per group, then cluster 0 only.

    Frames without a metric come first, equal ones in the order of their images. A quantile sketch brackets the last frame
    that is in; frames below the bracket are taken by a filter, and only those inside it are sorted.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    held = cut(frames.withColumn("_v", F.coalesce(F.col(metric).cast("double"), F.lit(-math.inf))))
    limits = cut(_brackets(held, by, share))
    placed = attach_measured(held, limits, by, [key], stored=True)
    bracket = placed.filter(F.col("_v").between(F.col("_low"), F.col("_high")))
    ranked = number_rows(bracket, by, [F.col(metric).asc(), *image_keys(key)], "_rank")
    best = placed.filter(F.col("_v") < F.col("_low")).select(*frames.columns).unionByName(
        ranked.filter(F.col("_rank") <= F.col("_wanted")).select(*frames.columns)
    )
    if cluster is not None:
        best = best.filter(F.col(cluster) == 0)
    return best


def systematic_sample(numbered: DataFrame, by: Sequence[str], n: int, rn: str = "rn") -> DataFrame:
    """``n`` evenly spread frames per group, at half-even rounded positions; all when there are fewer."""
    if n <= 0:
        raise ValueError("n must be positive")
    sizes = group_sizes(numbered, by, "_n")
    step = F.col("_n").cast("double") / n
    spots = sizes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        *by,
        F.when(F.col("_n") <= n, F.col("_i") + 1)
        .otherwise(F.bround(F.col("_i") * step).cast("long") + 1)
        .cast("long")
        .alias(rn),
    )
    return match(numbered, spots, [*by, rn], "left_semi")


def parity_split(frames: DataFrame, key: str = "image_id") -> DataFrame:
    """Mark every other frame in key order as training (even positions from zero)."""
    numbered = number_rows(frames, (), image_keys(key), "_rn")
    return numbered.withColumn("is_train", (F.col("_rn") - 1) % 2 == 0).drop("_rn")


def in_clusters(frames: DataFrame, clusters: int | Sequence[int], cluster: str = "cluster") -> DataFrame:
    """Frames of the given cluster or clusters."""
    wanted = [clusters] if isinstance(clusters, int) else list(clusters)
    return frames.filter(F.col(cluster).isin(wanted))


def reset_clusters(frames: DataFrame, cluster: str = "cluster") -> DataFrame:
    return frames.withColumn(cluster, F.lit(0))


def first_frame(frames: DataFrame, by: Sequence[str], fields: Sequence[str], key: str = "image_id") -> DataFrame:
    """Fields of the first frame by image number in each group, for example its size."""
    picked = frames.groupBy(*by).agg(F.min_by(F.struct(*fields), image_order(key)).alias("_first"))
    return picked.select(*by, *[F.col(f"_first.{f}").alias(f) for f in fields])


def flowers_present(frames: DataFrame, metric: str, threshold: float, check: bool = False) -> DataFrame:
    """One row saying whether the field shows flowers; constantly true unless checked."""
    if not check:
        return frames.agg(F.lit(True).alias("present"), F.max(metric).alias("max_share"))
    return frames.agg(
        F.coalesce(F.max(metric) > threshold, F.lit(False)).alias("present"), F.max(metric).alias("max_share")
    )


def drop_bad(frames: DataFrame, bad: DataFrame, image: str = "image_id") -> DataFrame:
    """Remove the images listed as bad."""
    return frames.join(bad.select(image), image, "left_anti")


def between_counted(frames: DataFrame, by: Sequence[str], counted: Column, ts: str = "ts", spread_by: str = "image_id") -> DataFrame:
    """Frames from the first to the last counted one, both included."""
    span = frames.filter(counted).groupBy(*by).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    ranged = attach_measured(frames, span, by, [spread_by])
    return ranged.filter(F.col(ts).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def nearest_label(value: Column, centroids: Sequence[float]) -> Column:
    """Index of the closest of the sorted centroids; the lower one on ties."""
    gaps = F.array(*[F.abs(value - float(c)) for c in sorted(centroids)])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def fit_centroids(frames: DataFrame, metric: str, k: int = 4, seed: int = 7, max_iter: int = 20) -> list[float]:
    """Sorted 1-D k-means centroids."""
    if k < 2:
        raise ValueError("need at least two clusters")
    points = frames.filter(F.col(metric).isNotNull()).select(
        array_to_vector(F.array(F.col(metric).cast("double"))).alias("features")
    )
    points.persist()
    try:
        model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(points)
    finally:
        points.unpersist()
    return sorted(float(c[0]) for c in model.clusterCenters())


def two_level_label(value: Column, level1: Sequence[float], level2: Sequence[float]) -> Column:
    """Labels 0..3: the lowest of three clusters is split in two."""
    coarse = nearest_label(value, level1)
    return F.when(coarse == 0, nearest_label(value, level2)).otherwise(coarse + 1)


def _labels_of(value: Column, centroids: Column) -> Column:
    gaps = F.transform(centroids, lambda c: F.abs(value - c))
    return F.array_position(gaps, F.array_min(gaps)) - 1


def fit_centroids_by(
    frames: DataFrame, by: Sequence[str], metric: str, k: int, max_iter: int = 1000, tol: float = 1e-9, rounds_per_job: int = 4
) -> DataFrame:
    """Sorted 1-D k-means centroids of every group as ``(by..., centroids)``.

    Starts evenly between the group's smallest and largest value and goes on
    until no centroid moves by more than ``tol``. Each round is one aggregation
    over the distinct values, several rounds make one job, which also tells how
    far the last of them moved; an emptied cluster keeps its centroid.
    """
    if k < 2:
        raise ValueError("need at least two clusters")
    known = frames.filter(F.col(metric).isNotNull())
    values = cut(known.groupBy(*by, F.col(metric).cast("double").alias("_v")).agg(F.count("*").alias("_n")))
    lo, hi = F.min("_v"), F.max("_v")
    start = F.array(*[lo + (hi - lo) * ((j + 0.5) / k) for j in range(k)])
    current, stored = values.groupBy(*by).agg(start.alias("centroids")), None

    def mean(j: int) -> Column:
        mine = F.col("_label") == j
        size = F.sum(F.when(mine, F.col("_n")))
        total = F.sum(F.when(mine, F.col("_v") * F.col("_n")))
        return F.coalesce(total / size, F.any_value("centroids")[j])

    for done in range(0, max_iter, rounds_per_job):
        for _ in range(min(rounds_per_job, max_iter - done)):
            paired = match(values, current.select(*by, "centroids"), by)
            labelled = paired.withColumn("_label", _labels_of(F.col("_v"), F.col("centroids")))
            current = labelled.groupBy(*by).agg(
                F.array(*[mean(j) for j in range(k)]).alias("centroids"), F.any_value("centroids").alias("_old")
            )
        gap = F.array_max(F.zip_with("centroids", "_old", lambda a, b: F.abs(a - b)))
        last = stored
        stored, seen = cut_measured(current, gap=F.max(gap))
        current = stored
        if last is not None:
            discard(last)
        if seen["gap"] is None or seen["gap"] <= tol:
            discard(values)
            return stored.select(*by, F.array_sort("centroids").alias("centroids"))
    raise RuntimeError(f"centroids did not settle within {max_iter} rounds")


def cluster_frames(
    frames: DataFrame, by: Sequence[str], metric: str, cluster: str = "cluster", key: str = "image_id", max_iter: int = 1000
) -> DataFrame:
    """Fit both levels in every group and label every frame 0..3; frames without the metric get no label."""
    level1 = fit_centroids_by(frames, by, metric, 3, max_iter)
    coarse = cut(
        attach_measured(frames, level1, by, [key], stored=True, how="left")
        .withColumn("_coarse", _labels_of(F.col(metric), F.col("centroids")))
        .drop("centroids")
    )
    level2 = fit_centroids_by(coarse.filter(F.col("_coarse") == 0), by, metric, 2, max_iter)
    fine = _labels_of(F.col(metric), F.col("centroids"))
    label = F.when(F.col("_coarse") == 0, fine).otherwise(F.col("_coarse") + 1).cast("int")
    labelled = attach_measured(coarse, level2, by, [key], stored=True, how="left").withColumn(cluster, label)
    return labelled.drop("centroids", "_coarse")

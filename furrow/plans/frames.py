"""Frame analysis: from image files to daily flower figures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import gray_array, lab_b_array
from ..functions.geometry import inside_quad, inside_regions, mask_array, quad_mask, region_mask
from ..joins import attach, match, parted
from ..lineage import cut
from ..operators import histogram, peaks, periods, series
from ..params import FrameParams
from ..sources import cache, generations
from ..sources.images import exactly, file_set, file_versions, scan_images

FEATURES = (
    "path string, image_id string, batch string, number bigint, ok boolean, "
    "hist_gray array<bigint>, hist array<bigint>, area binary"
)
# Frames whose features a task holds at a time: some 50 kB each at the default geometry.
PART_FRAMES = 512


def plot_mask(params: FrameParams) -> np.ndarray:
    return mask_array(
        lambda x, y: inside_quad(x, y, params.plot, params.height, params.width), params.height, params.width
    )


def area_mask(params: FrameParams) -> np.ndarray:
    """Flower area, in the frame of the whole image."""
    return mask_array(
        lambda x, y: np.broadcast_to(
            inside_regions(x, y, params.regions, params.plot, params.height, params.width), x.shape
        ),
        params.height,
        params.width,
    )


Mask = np.ndarray | DataFrame
Masks = tuple[Mask, Mask]


def stored_masks(spark: SparkSession, cache_dir: str, params: FrameParams) -> tuple[DataFrame, DataFrame]:
    """Plot and flower-area masks of the parameters as tables ``(y, x)``; drawn once, then loaded."""
    size = (params.height, params.width)
    return (
        cache.load_or_compute(
            spark, f"{cache_dir}/plot_mask", f"{params.plot}|{size}", lambda: quad_mask(spark, params.plot, *size)
        ),
        cache.load_or_compute(
            spark, f"{cache_dir}/area_mask", f"{params.regions}|{params.plot}|{size}",
            lambda: region_mask(spark, params.regions, params.plot, *size),
        ),
    )


def _drawn(mask: Mask, params: FrameParams) -> np.ndarray:
    """A mask as an array. Of a table ``(y, x)`` the driver gets the pixels of one frame, each once, and no others."""
    if not isinstance(mask, DataFrame):
        return mask
    inside = F.col("y").between(0, params.height - 1) & F.col("x").between(0, params.width - 1)
    kept = mask.filter(inside).select(F.col("y").cast("int"), F.col("x").cast("int")).distinct().toPandas()
    drawn = np.zeros((params.height, params.width), dtype=bool)
    drawn[kept["y"].to_numpy(int), kept["x"].to_numpy(int)] = True
    return drawn


def frame_masks(params: FrameParams, masks: Masks | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Plot and flower-area masks: given ones, as arrays of the frame's size or tables ``(y, x)``, or those of the parameters."""
    if masks is None:
        return plot_mask(params), area_mask(params)
    masks = tuple(_drawn(mask, params) for mask in masks)
    for mask in masks:
        if mask.shape != (params.height, params.width):
            raise ValueError(f"mask of shape {mask.shape} does not fit the frame")
    return masks[0] > 0, masks[1] > 0


def _window(mask: np.ndarray) -> tuple[slice, slice]:
    """Smallest rectangle around the mask."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return slice(0, 0), slice(0, 0)
    return slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1)


def frame_features(images: DataFrame, params: FrameParams, masks: Masks | None = None) -> DataFrame:
    """Everything later steps need of an image, from one decode.

    Per image: gray and Lab b histograms of the plot, and the Lab b levels of
    the flower area (46 kB of a 2.7 MB frame at the default geometry). Files
    that do not decode, or have another size, keep their row with ``ok`` false.
    """
    plot, area = frame_masks(params, masks)
    plot_box, area_box = _window(plot), _window(area)
    plot = plot[plot_box]
    size = (params.height, params.width)

    def per_frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows go on in small parts: the features of a whole batch are never held.
        parts = (batch.iloc[i : i + PART_FRAMES] for batch in batches for i in range(0, len(batch), PART_FRAMES))
        for batch in parts:
            out = {"ok": [], "hist_gray": [], "hist": [], "area": []}
            for height, width, channels, data in zip(batch["height"], batch["width"], batch["channels"], batch["data"]):
                ok = (height, width) == size and channels in (1, 3, 4)
                out["ok"].append(ok)
                if not ok:
                    for name in ("hist_gray", "hist", "area"):
                        out[name].append(None)
                    continue
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
                bgr = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., :3]
                boxed = bgr[plot_box]
                in_plot = boxed if plot.all() else boxed[plot]
                out["hist_gray"].append(np.bincount(gray_array(in_plot).ravel(), minlength=256))
                out["hist"].append(np.bincount(lab_b_array(in_plot).ravel(), minlength=256))
                out["area"].append(lab_b_array(bgr[area_box]).astype(np.uint8).tobytes())
            yield batch[["path", "image_id", "batch", "number"]].assign(**out)

    return images.select(
        "path",
        "image_id",
        "batch",
        "number",
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.when(F.col("image.height") > 0, F.col("image.data")).alias("data"),
    ).mapInPandas(per_frame, FEATURES)


def rejects(features: DataFrame) -> DataFrame:
    """Images that could not be used."""
    return features.filter(~F.col("ok")).select("path", "image_id", "batch")


def _is_bad(params: FrameParams) -> Column:
    return histogram.is_bad_frame(F.col("hist_gray"), F.lit(params.height * params.width), params.bad_share)


def _share(params: FrameParams, plot: np.ndarray) -> Column:
    n_plot = F.lit(int(plot.sum()))
    return histogram.range_share(F.col("hist"), F.col("shift"), params.lower, params.upper, n_plot)


def _spots(params: FrameParams, area: np.ndarray) -> Column:
    return peaks.spots_of_area(
        F.col("area"),
        F.col("shift"),
        area[_window(area)],
        params.lower,
        params.highlight,
        params.highlight_distance,
        params.highlight_out,
        params.min_peak,
    )


def analyze(
    features: DataFrame,
    params: FrameParams,
    reference: str = "first",
    by: Sequence[str] = ("batch",),
    masks: Masks | None = None,
) -> DataFrame:
    """Shift, flower-pixel share and spot count of every usable image.

    ``reference`` is ``first`` (first image, then moved by its shift against
    the mean) or ``mean``.
    """
    if reference not in ("first", "mean"):
        raise ValueError("reference is 'first' or 'mean'")
    plot, area = frame_masks(params, masks)
    shifted = histogram.with_shift_to_first if reference == "first" else histogram.with_shift_to_mean
    return shifted(features.filter("ok"), by).select(
        *by, "image_id", "number", "shift", _share(params, plot).alias("share"), _spots(params, area).alias("n_spots")
    )


def count_spots(
    usable: DataFrame, means: DataFrame, best: DataFrame, params: FrameParams, area: np.ndarray, by: Sequence[str]
) -> DataFrame:
    """Spots ``(by..., image_id, n_spots)`` of the frames listed in ``best``.

    Areas do not meet the list in a shuffle. A Bloom filter of the list lets its frames by where they are read; these get
    their shift against the ``means`` once more and their count, and the counts, a few bytes each, meet the list.
    """
    key = F.xxhash64(*by, "image_id").alias("_frame")
    asked, _ = parted(usable.select(*by, "image_id", "hist", "area", key), "_frame", best.select(key))
    shifted = histogram.with_shift(asked.drop("_frame"), means, by)
    counts = shifted.select(*by, "image_id", _spots(params, area).alias("n_spots"))
    return match(counts, best, [*by, "image_id"], "left_semi")


def run_batch(
    spark: SparkSession,
    path: str,
    params: FrameParams,
    cache_dir: str | None = None,
    glob: str = "*.jpg",
    masks: Masks | None = None,
    timestamps: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Analyse folders of images, one batch per folder.

    Features are kept per file and reused while the parameters, the masks and
    the file stay the same, so a folder that grows has only its new files
    decoded; the finished frame table is reused while no file changes.
    ``masks`` gives plot and flower area, as arrays or as tables ``(y, x)``,
    instead of the parameters' geometry. ``timestamps`` (image_id, ts)
    are filled in and joined; frames without one keep a null. Returns
    ``frames`` (bad frames removed), ``bad`` and ``rejects``.
    """
    by = ["batch"]
    masks = frame_masks(params, masks) if masks else None
    drawn = hashlib.sha256(b"".join(np.ascontiguousarray(m).tobytes() for m in masks)).hexdigest() if masks else ""
    made = f"{path}|{glob}|{params.stamp()}|{drawn}"

    def build(paths: str | Sequence[str]) -> DataFrame:
        return frame_features(scan_images(spark, paths, glob), params, masks)

    if cache_dir:
        versions = file_versions(spark, path, glob)
        stamp = f"{made}|{file_set(spark, path, glob)}"
        features = generations.load_or_extend(
            spark, f"{cache_dir}/features", made, versions, lambda new: build([exactly(p) for p in new] or path)
        )
    else:
        features = cut(build(path))

    def finish() -> DataFrame:
        plot, area = frame_masks(params, masks)
        usable = features.filter("ok")
        means = cut(histogram.mean_references(usable, by))
        shares = cut(
            histogram.with_shift(usable, means, by).select(
                "batch", "image_id", "number", "shift", _share(params, plot).alias("share"), _is_bad(params).alias("is_bad")
            )
        )
        good = shares.filter(~F.col("is_bad")).drop("is_bad")
        labelled = cut(series.cluster_frames(good, by, "share"))
        # The best share counts all images; bad ones then fall out by their missing label.
        with_bad = match(shares, labelled.select("batch", "image_id", "cluster"), [*by, "image_id"], "left")
        best = series.best_frames(with_bad, by, "share", params.best_share, cluster="cluster")
        counted = count_spots(usable, means, cut(best.select(*by, "image_id")), params, area, by)
        if params.check_present:
            present = series.flowers_present(labelled, "share", params.present_threshold, True).select("present")
            counted = attach(counted, present, [], ["image_id"]).select(
                "batch", "image_id", F.when(F.col("present"), F.col("n_spots")).otherwise(0).alias("n_spots")
            )
        marked = match(labelled, counted, [*by, "image_id"], "left")
        return marked.withColumn("is_best", F.col("n_spots").isNotNull())

    frames = cache.load_or_compute(spark, f"{cache_dir}/frames", stamp, finish) if cache_dir else finish()
    if timestamps is not None:
        timed = match(frames.drop("ts"), timestamps.select("image_id", "ts"), ["image_id"], "left")
        frames = series.fill_timestamps(timed, by)
    bad = features.filter("ok").filter(_is_bad(params)).select("batch", "image_id")
    return {"frames": frames, "bad": bad, "rejects": rejects(features)}


def count_series(
    frames: DataFrame, by: Sequence[str] = ("batch",), smooth: bool = False, count: str = "n_spots", name: str = "count_estimate"
) -> DataFrame:
    """Frames with an estimated count: interpolated between counted frames in order of time, then smoothed if asked for."""
    numbered = series.number_frames(frames, by)
    estimate = series.estimate if smooth else series.interpolate
    return estimate(numbered, by, F.col(count), name).drop("rn")


def report(
    frames: DataFrame,
    limits: Sequence[str] | None,
    zone: str = "America/Regina",
    by: Sequence[str] = ("batch",),
    tolerance: float = 5,
    skip_share: bool = False,
    skip_count: bool = False,
    skip_share_estimate: bool = False,
    present_threshold: float | None = None,
) -> DataFrame:
    """Mean share and typical count per group and period; -1 where skipped or empty.

    ``frames`` carries ``image_id, ts, share, is_best, n_spots``. With a
    ``present_threshold``, a group in which no share exceeds it shows no
    flowers: its shares and counts are 0.
    """
    if present_threshold is not None:
        shows = frames.groupBy(*by).agg(F.coalesce(F.max("share") > present_threshold, F.lit(False)).alias("_shows"))
        gated = match(frames, shows, by)
        frames = gated.withColumns(
            {c: F.when(F.col("_shows") | F.col(c).isNull(), F.col(c)).otherwise(F.lit(0)) for c in ("share", "n_spots")}
        ).drop("_shows")
    numbered = series.number_frames(frames.select(*by, "image_id", "ts", "share", "is_best", "n_spots"), by)
    if skip_share or skip_share_estimate:
        estimated = numbered.withColumn("estimate", F.col("share"))
    else:
        known = F.when(F.col("is_best"), F.col("share"))
        estimated = series.estimate(numbered, by, known, "estimate")
    estimated = cut(estimated)
    shares = periods.mean_by_period(estimated, by, "estimate", limits, zone, "mean_share")
    counts = periods.modal_by_period(
        estimated, by, "n_spots", limits, zone, tolerance, "typical_count", F.col("n_spots").isNotNull()
    )
    both = match(shares, counts, [*by, "period"])
    if skip_share:
        both = both.withColumn("mean_share", F.lit(-1.0))
    if skip_count:
        both = both.withColumn("typical_count", F.lit(-1.0))
    return both

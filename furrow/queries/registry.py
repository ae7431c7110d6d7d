"""The registered queries: each runs one operator over whole shared tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, geometry, highlight
from ..joins import attach_measured
from ..lineage import cut, shared_dir
from ..operators import clusters, correlation, divergence, graph, histogram, order, peaks, periods, series
from ..operators import counts as tables
from ..params import DEFAULT_PLOT, FrameParams, WinnowParams
from ..plans import frames as frame_plans
from ..plans import grouping, winnow
from ..sources import cache
from ..sources import tables as files
from . import inputs
from .inputs import LIMITS, SIDE, SMALL_PLOT, WHOLE_FRAME, clock_text, rounded, settled

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

DAY = ["batch"]
LOWER, UPPER = 20, 60
KEEP_THRESH = WinnowParams().keep_thresh
LEVEL1, LEVEL2 = (10.0, 60.0, 150.0), (5.0, 25.0)
SMALL_FRAME = FrameParams(
    height=SIDE, width=SIDE, plot=SMALL_PLOT, regions=((1,),), lower=120, upper=200, highlight="linear"
)


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- histograms -----------------------------------------------------------


def _packed(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    keys = [*by, "image_id"]
    return histogram.pack(histogram.count_bins(inputs.hist_rows(spark, sf_dir), keys), keys)


@query
def image_histogram(spark, sf_dir):
    return histogram.count_bins(inputs.hist_rows(spark, sf_dir), ["image_id"])


@query
def mean_histogram(spark, sf_dir):
    counted = histogram.count_bins(inputs.hist_rows(spark, sf_dir), ["image_id"])
    return histogram.mean_of_bins(counted, ["image_id"]).withColumn("mean_n", rounded(F.col("mean_n")))


@query
def histogram_shift_mean(spark, sf_dir):
    packed = cut(_packed(spark, sf_dir))
    return histogram.with_shift_to_mean(packed).select("image_id", "shift")


@query
def histogram_shift_first(spark, sf_dir):
    packed = cut(_packed(spark, sf_dir))
    return histogram.with_shift_to_first(packed).select("image_id", "shift")


@query
def histogram_shift_by_batch(spark, sf_dir):
    packed = cut(_packed(spark, sf_dir, "batch"))
    return histogram.with_shift_to_mean(packed, ["batch"]).select("batch", "image_id", "shift")


@query
def aligned_mean_histogram(spark, sf_dir):
    shifted = histogram.with_shift_to_mean(cut(_packed(spark, sf_dir)))
    return histogram.aligned_mean(shifted).withColumn("mean_n", rounded(F.col("mean_n")))


@query
def flower_fraction(spark, sf_dir):
    """Histogram per image, shift against the mean, share of pixels in the shifted range."""
    shifted = histogram.with_shift_to_mean(cut(_packed(spark, sf_dir)))
    n_plot = histogram.total(F.col("hist"))
    share = histogram.range_share(F.col("hist"), F.col("shift"), LOWER, UPPER, n_plot)
    return shifted.select("image_id", "shift", rounded(share).alias("share"))


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.image_sizes(histogram.count_bins(inputs.coarse_hist_rows(spark, sf_dir), ["image_id"]), ["image_id"])


def _one_level(sizes: DataFrame) -> DataFrame:
    return sizes.filter(histogram.too_full(F.col("largest"), F.col("n_pixels")))


@query
def largest_bin(spark, sf_dir):
    return _coarse(spark, sf_dir).select("image_id", "largest")


@query
def bad_frames(spark, sf_dir):
    return _one_level(_coarse(spark, sf_dir)).select("image_id")


@query
def drop_bad_frames(spark, sf_dir):
    sizes = _coarse(spark, sf_dir)
    return series.drop_bad(sizes, _one_level(sizes)).select("image_id", "n_pixels")


# --- frame series ---------------------------------------------------------


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.frames(spark, sf_dir).select("batch", "image_id", "ts", "metric", "counted")
    return series.number_frames(rows, DAY)


@query
def fill_timestamps(spark, sf_dir):
    filled = series.fill_timestamps(inputs.frames_with_gaps(spark, sf_dir))
    return filled.withColumn("ts", clock_text(F.col("ts")))


@query
def known_timestamps(spark, sf_dir):
    rows = inputs.frames(spark, sf_dir)
    known = series.known_images(rows.select("image_id", "ts"), rows.filter("counted"))
    return known.withColumn("ts", clock_text(F.col("ts")))


@query
def interpolate_metric(spark, sf_dir):
    known = F.when(F.col("counted"), F.col("metric"))
    out = series.interpolate(_numbered(spark, sf_dir), DAY, known, "estimate")
    return out.select("batch", "image_id", rounded(F.col("estimate"), 8).alias("estimate"))


@query
def interpolate_count(spark, sf_dir):
    known = F.when(F.col("counted"), F.floor("metric"))
    out = series.interpolate(_numbered(spark, sf_dir), DAY, known, "estimate")
    return out.select("batch", "image_id", rounded(F.col("estimate"), 8).alias("estimate"))


@query
def moving_average_60(spark, sf_dir):
    out = series.smooth(_numbered(spark, sf_dir), DAY, "metric", "smoothed")
    return out.select("batch", "image_id", rounded(F.col("smoothed"), 8).alias("smoothed"))


@query
def estimate_metric(spark, sf_dir):
    known = F.when(F.col("counted"), F.col("metric"))
    out = series.estimate(_numbered(spark, sf_dir), DAY, known, "estimate")
    return out.select("batch", "image_id", settled(F.col("estimate")).alias("estimate"))


@query
def fraction_by_period(spark, sf_dir):
    out = periods.mean_by_period(inputs.frames(spark, sf_dir), DAY, "metric", LIMITS)
    return out.withColumn("mean_share", settled(F.col("mean_share")))


@query
def fraction_by_local_period(spark, sf_dir):
    out = periods.mean_by_period(inputs.frames(spark, sf_dir), DAY, "metric", LIMITS, "America/Regina")
    return out.withColumn("mean_share", settled(F.col("mean_share")))


@query
def fraction_by_day(spark, sf_dir):
    out = periods.mean_by_period(inputs.frames(spark, sf_dir), DAY, "metric")
    return out.withColumn("mean_share", settled(F.col("mean_share")))


@query
def modal_count_by_period(spark, sf_dir):
    return periods.modal_by_period(inputs.frames(spark, sf_dir), DAY, "metric", LIMITS, counted=F.col("counted"))


@query
def modal_count_by_day(spark, sf_dir):
    return periods.modal_by_period(inputs.frames(spark, sf_dir), DAY, "metric", tolerance=10)


@query
def count_histogram(spark, sf_dir):
    rows = inputs.frames(spark, sf_dir).withColumn("spots", F.floor("metric"))
    return periods.count_histogram(rows, DAY, "spots", 4)


@query
def between_counted(spark, sf_dir):
    rows = inputs.frames(spark, sf_dir)
    return series.between_counted(rows, DAY, F.col("counted")).select("batch", "image_id", "metric")


@query
def fraction_series(spark, sf_dir):
    rows = inputs.frames(spark, sf_dir).orderBy("batch", "ts")
    return rows.select("batch", clock_text(F.col("ts")).alias("ts"), "metric")


@query
def best_frames(spark, sf_dir):
    rows = inputs.frames(spark, sf_dir).withColumn("cluster", series.nearest_label(F.col("metric"), LEVEL1))
    return series.best_frames(rows, DAY, "metric", cluster="cluster").select("batch", "image_id", "metric")


@query
def systematic_sample(spark, sf_dir):
    return series.systematic_sample(_numbered(spark, sf_dir), DAY, 24).select("batch", "image_id", "rn")


@query
def parity_split(spark, sf_dir):
    return series.parity_split(inputs.frames(spark, sf_dir).select("image_id"))


@query
def first_frame(spark, sf_dir):
    return series.first_frame(inputs.frames(spark, sf_dir), DAY, ["image_id", "metric"])


@query
def frame_number(spark, sf_dir):
    """Sort key from file names."""
    name = F.concat("batch", F.lit("/"), F.col("image_id").cast("string"), F.lit(".jpg"))
    return inputs.frames(spark, sf_dir).select(name.alias("path"), series.file_number(name).alias("number"))


@query
def reset_clusters(spark, sf_dir):
    return series.reset_clusters(inputs.frames(spark, sf_dir)).groupBy("batch", "cluster").agg(F.count("*").alias("n"))


@query
def cluster_filter(spark, sf_dir):
    rows = inputs.frames(spark, sf_dir).withColumn("cluster", series.nearest_label(F.col("metric"), LEVEL1))
    return series.in_clusters(rows, (1, 2)).select("image_id", "cluster")


@query
def flowers_present(spark, sf_dir):
    out = series.flowers_present(inputs.frames(spark, sf_dir), "metric", 0.0001, check=True)
    return out.withColumn("present", F.col("present").cast("int"))


@query
def assign_1d(spark, sf_dir):
    label = series.nearest_label(F.col("metric"), (1.0, 20.0, 50.0, 120.0))
    return inputs.frames(spark, sf_dir).select("image_id", label.alias("cluster"))


@query
def two_level_cluster(spark, sf_dir):
    label = series.two_level_label(F.col("metric"), LEVEL1, LEVEL2)
    return inputs.frames(spark, sf_dir).select("image_id", label.alias("cluster"))


@query
def centroids_by_batch(spark, sf_dir):
    """1-D k-means in every batch, until it settles."""
    fitted = series.fit_centroids_by(inputs.frames(spark, sf_dir), DAY, "metric", 3)
    return fitted.select("batch", F.posexplode("centroids").alias("cluster", "centroid")).withColumn(
        "centroid", settled(F.col("centroid"))
    )


@query
def two_level_fit(spark, sf_dir):
    """Sizes of the four fitted clusters."""
    labelled = series.cluster_frames(inputs.frames(spark, sf_dir), DAY, "metric")
    return labelled.groupBy("batch", "cluster").agg(F.count("*").alias("n"), F.min("metric").alias("lo"))


@query
def daily_report(spark, sf_dir):
    """Interpolation, smoothing, then share and typical count per period."""
    rows = inputs.frames(spark, sf_dir).select(
        "batch",
        "image_id",
        "ts",
        F.col("metric").alias("share"),
        F.col("counted").alias("is_best"),
        F.when(F.col("counted"), F.floor("metric")).alias("n_spots"),
    )
    out = frame_plans.report(rows, LIMITS, "UTC")
    return out.withColumn("mean_share", settled(F.col("mean_share")))


# --- geometry and pixels --------------------------------------------------


def _in_small_plot():
    return geometry.inside_quad(F.col("x"), F.col("y"), SMALL_PLOT, SIDE, SIDE)


@query
def quad_mask(spark, sf_dir):
    pixels = inputs.pixels_gray(spark, sf_dir)
    kept = pixels.filter(_in_small_plot())
    return kept.groupBy("image_id").agg(F.count("*").alias("n_pixels"), rounded(F.sum("v")).alias("total"))


@query
def region_mask(spark, sf_dir):
    regions = ((0, 0, 0), (0, 1, 0), (0, 0, 1))
    inside = geometry.inside_regions(F.col("x"), F.col("y"), regions, WHOLE_FRAME, SIDE, SIDE)
    return inputs.pixels_gray(spark, sf_dir).filter(inside).select("image_id", "y", "x")


@query
def mask_union(spark, sf_dir):
    """Pixels kept by a stored mask: the union of two plots."""
    one = geometry.quad_mask(spark, ((0, 0), (4, 0), (0, 4), (4, 4)), SIDE, SIDE)
    two = geometry.quad_mask(spark, ((2, 2), (7, 2), (2, 7), (7, 7)), SIDE, SIDE)
    kept = peaks.masked_pixels(inputs.pixels_gray(spark, sf_dir), geometry.union_masks(one, two))
    return kept.groupBy("image_id").agg(F.count("*").alias("n_pixels"), rounded(F.sum("v")).alias("total"))


def _plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels of a full frame."""
    lines = inputs.table(spark, sf_dir, "lineitem")
    spot = F.col("l_orderkey") * 7 + F.col("l_partkey")
    return lines.select(
        F.col("l_linestatus").alias("image_id"),
        (spot % 1280).cast("int").alias("x"),
        ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % 720).cast("int").alias("y"),
    )


@query
def default_plot_points(spark, sf_dir):
    inside = geometry.inside_quad(F.col("x"), F.col("y"), DEFAULT_PLOT, 720, 1280)
    return _plot_points(spark, sf_dir).filter(inside).groupBy("image_id").agg(F.count("*").alias("n_points"))


@query
def default_area_points(spark, sf_dir):
    params = FrameParams()
    inside = geometry.inside_regions(F.col("x"), F.col("y"), params.regions, params.plot, 720, 1280)
    return _plot_points(spark, sf_dir).filter(inside).groupBy("image_id").agg(F.count("*").alias("n_points"))


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


@query
def gray_pixels(spark, sf_dir):
    return inputs.pixels_bgr(spark, sf_dir).select("image_id", "y", "x", color.gray(*_rgb()).alias("gray"))


@query
def lab_b_pixels(spark, sf_dir):
    return inputs.pixels_bgr(spark, sf_dir).select("image_id", "y", "x", color.lab_b(*_rgb()).alias("lab_b"))


@query
def luminance(spark, sf_dir):
    value = rounded(color.luminance(*_rgb()), 9)
    return inputs.pixels_bgr(spark, sf_dir).select("image_id", "y", "x", value.alias("luma"))


@query
def masked_histogram(spark, sf_dir):
    pixels = inputs.pixels_bgr(spark, sf_dir)
    kept = pixels.filter(_in_small_plot()).withColumn("bin", color.lab_b(*_rgb()))
    return histogram.count_bins(kept, ["image_id"])


def _lab_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = inputs.pixels_bgr(spark, sf_dir).filter(_in_small_plot())
    return pixels.select("image_id", "y", "x", color.lab_b(*_rgb()).alias("lab_b"))


@query
def flower_mask_pixels(spark, sf_dir):
    kept = highlight.in_flower_range(F.col("lab_b"), F.lit(0), 120, 200)
    return _lab_pixels(spark, sf_dir).filter(kept).select("image_id", "y", "x")


@query
def highlight_logistic(spark, sf_dir):
    value = rounded(highlight.logistic(F.col("lab_b"), F.lit(0), 140))
    return _lab_pixels(spark, sf_dir).select("image_id", "y", "x", value.alias("v"))


@query
def highlight_linear(spark, sf_dir):
    value = rounded(highlight.linear(F.col("lab_b"), F.lit(0), 140))
    return _lab_pixels(spark, sf_dir).select("image_id", "y", "x", value.alias("v"))


def _shifted_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot pixels with their image's shift against the mean histogram of all plots."""
    pixels = cut(_lab_pixels(spark, sf_dir))
    counted = histogram.count_bins(pixels.withColumnRenamed("lab_b", "bin"), ["image_id"])
    shifts = histogram.with_shift_to_mean(cut(histogram.pack(counted, ["image_id"]))).select("image_id", "shift")
    return attach_measured(pixels, shifts, ["image_id"], ["y", "x"])


@query
def flower_mask_shifted(spark, sf_dir):
    """Flower pixels by a range that moves with the exposure."""
    kept = highlight.in_flower_range(F.col("lab_b"), F.col("shift"), 120, 150)
    return _shifted_pixels(spark, sf_dir).filter(kept).select("image_id", "y", "x")


@query
def highlight_logistic_shifted(spark, sf_dir):
    value = rounded(highlight.logistic(F.col("lab_b"), F.col("shift"), 140))
    return _shifted_pixels(spark, sf_dir).select("image_id", "y", "x", value.alias("v"))


@query
def highlight_linear_shifted(spark, sf_dir):
    value = rounded(highlight.linear(F.col("lab_b"), F.col("shift"), 140))
    return _shifted_pixels(spark, sf_dir).select("image_id", "y", "x", value.alias("v"))


@query
def spot_peaks(spark, sf_dir):
    found = peaks.local_peaks(inputs.pixels_gray(spark, sf_dir), threshold=0.1)
    return found.withColumn("score", rounded(F.col("score")))


@query
def spot_count(spark, sf_dir):
    pixels = inputs.pixels_gray(spark, sf_dir)
    return peaks.count_per_image(peaks.local_peaks(pixels, threshold=0.1), peaks.spot_images(pixels))


@query
def frame_analysis(spark, sf_dir):
    """Whole frames: decode once, histograms, shifts, share and spots per image."""
    features = cut(frame_plans.frame_features(inputs.bgr_images(spark, sf_dir), SMALL_FRAME))
    out = frame_plans.analyze(features, SMALL_FRAME)
    return out.select("batch", "image_id", "shift", rounded(F.col("share")).alias("share"), "n_spots")


# --- descriptors ----------------------------------------------------------


@query
def explode_descriptors(spark, sf_dir):
    rows = clusters.explode_descriptors(inputs.descriptor_records(spark, sf_dir))
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("image_id", "pos", rounded(total).alias("total"))


@query
def first_descriptor(spark, sf_dir):
    rows = clusters.first_descriptors(inputs.descriptor_records(spark, sf_dir))
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("image_id", rounded(total).alias("total"))


@query
def tile_descriptors(spark, sf_dir):
    tiles = clusters.tile_descriptors(inputs.pixels_gray(spark, sf_dir), size=4)
    names = ("mean", "variance", "slope_x", "slope_y")
    return tiles.select(
        "image_id", "tile_y", "tile_x", *[rounded(F.col("vec")[i]).alias(n) for i, n in enumerate(names)]
    )


def _words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = inputs.descriptors(spark, sf_dir)
    centres = clusters.mean_centres(rows, "label")
    return clusters.assign_words(rows.select("image_id", "pos", "vec"), centres), len(centres)


@query
def nearest_center(spark, sf_dir):
    words, _ = _words(spark, sf_dir)
    return words.select("image_id", "pos", "word", rounded(F.col("dist")).alias("dist"))


def _pooled(spark: SparkSession, sf_dir: str, pooling: str) -> DataFrame:
    words, k = _words(spark, sf_dir)
    return clusters.pooled_vectors(words, k, pooling)


@query
def pooled_max(spark, sf_dir):
    rows = clusters.pooled_rows(_pooled(spark, sf_dir, "max"))
    return rows.withColumn("pooled", rounded(F.col("pooled")))


@query
def pooled_sum(spark, sf_dir):
    rows = clusters.pooled_rows(_pooled(spark, sf_dir, "sum"))
    return rows.withColumn("pooled", rounded(F.col("pooled")))


@query
def image_group(spark, sf_dir):
    return clusters.group_of(_pooled(spark, sf_dir, "max"))


@query
def image_group_used(spark, sf_dir):
    return clusters.group_of(_pooled(spark, sf_dir, "max"), empty="ignore")


@query
def group_members(spark, sf_dir):
    return clusters.group_members(clusters.group_of(_pooled(spark, sf_dir, "max"), empty="ignore"))


@query
def kmeans_groups(spark, sf_dir):
    rows = inputs.descriptors(spark, sf_dir).select("image_id", "pos", "vec")
    return grouping.group_images(rows, start=clusters.first_centres(rows, 3))


@query
def kmeans_first(spark, sf_dir):
    first = clusters.first_vectors(inputs.descriptors(spark, sf_dir))
    return clusters.kmeans_labels(first, start=clusters.first_centres(first, 3, "image_id"))


# --- count tables ---------------------------------------------------------


@query
def stack_conditions(spark, sf_dir):
    """The table of one condition and that of all others, put under one another."""
    rows = inputs.counts(spark, sf_dir)
    one = F.col("condition").eqNullSafe(F.lit("F"))
    return tables.stack(rows.filter(one), rows.filter(~one)).groupBy("condition").agg(F.count("*").alias("n_cells"), F.sum("n").alias("total"))


@query
def wide_matrix(spark, sf_dir):
    """Wide matrix of all samples and taxa back to long form."""
    rows = inputs.with_sample(inputs.counts(spark, sf_dir))
    wide = rows.groupBy("sample").pivot("taxon").agg(F.sum("n"))
    return tables.to_long(wide, name="sample")


@query
def melt_positive(spark, sf_dir):
    """Positive entries of the taxon-by-condition matrix, as an edge list."""
    rows = inputs.fine_counts(spark, sf_dir)
    wide = rows.groupBy(F.col("taxon").alias("var1")).pivot("condition").agg(F.sum("n"))
    return correlation.melt_matrix(wide.fillna(0.0))


@query
def prune_taxa(spark, sf_dir):
    return tables.prune_taxa(inputs.fine_counts(spark, sf_dir), 90)


@query
def smooth_a(spark, sf_dir):
    rows = inputs.with_sample(inputs.counts(spark, sf_dir))
    out = tables.smooth_matrix(rows, ["sample"], "a")
    return out.select("sample", "taxon", rounded(F.col("smoothed"), 9).alias("smoothed"))


@query
def smooth_b(spark, sf_dir):
    rows = inputs.with_sample(inputs.counts(spark, sf_dir))
    out = tables.smooth_matrix(rows, ["sample"], "b")
    return out.select("sample", "taxon", rounded(F.col("smoothed"), 9).alias("smoothed"))


@query
def profiles(spark, sf_dir):
    return tables.profiles(inputs.fine_counts(spark, sf_dir), "F", "O")


@query
def align_profiles(spark, sf_dir):
    rows = inputs.fine_counts(spark, sf_dir)
    return tables.align(tables.profiles(rows, "F", "O"), tables.prune_taxa(rows, 90).select("taxon"))


@query
def smooth_profiles(spark, sf_dir):
    out = tables.smooth_profiles(tables.profiles(inputs.fine_counts(spark, sf_dir), "F", "O"))
    return out.select("taxon", rounded(F.col("a"), 9).alias("a"), rounded(F.col("b"), 9).alias("b"))


def _correlations(spark: SparkSession, sf_dir: str, method: str) -> tuple[DataFrame, DataFrame]:
    return correlation.correlations(inputs.with_sample(inputs.counts(spark, sf_dir)), method)


@query
def pearson_matrix(spark, sf_dir):
    pairs, _ = _correlations(spark, sf_dir, "pearson")
    return pairs.withColumn("r", rounded(F.col("r")))


@query
def spearman_matrix(spark, sf_dir):
    pairs, _ = _correlations(spark, sf_dir, "spearman")
    return pairs.withColumn("r", rounded(F.col("r")))


def _strong(rows: DataFrame, method: str) -> DataFrame:
    edges, _ = correlation.strong_pairs(rows, method, KEEP_THRESH)
    return edges.withColumn("weight", rounded(F.col("weight")))


@query
def pearson_edges(spark, sf_dir):
    return _strong(inputs.with_sample(inputs.linked_counts(spark, sf_dir)), "pearson")


@query
def spearman_edges(spark, sf_dir):
    return _strong(inputs.with_sample(inputs.linked_counts(spark, sf_dir)), "spearman")


@query
def sparse_pearson_edges(spark, sf_dir):
    """Over a thousand taxa, most cells absent: several tiles."""
    return _strong(inputs.with_sample(inputs.linked_fine_counts(spark, sf_dir)), "pearson")


@query
def sparse_spearman_edges(spark, sf_dir):
    return _strong(inputs.with_sample(inputs.linked_fine_counts(spark, sf_dir)), "spearman")


# --- graphs ---------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges, taxa = correlation.strong_pairs(inputs.with_sample(inputs.linked_counts(spark, sf_dir)), "pearson", KEEP_THRESH)
    return taxa.select(F.col("taxon").alias("id")), cut(edges)


def _scored(spark: SparkSession, sf_dir: str, kind: str, **options) -> DataFrame:
    scores = graph.centrality(*_graph(spark, sf_dir), kind, **options)
    return scores.select("node", rounded(F.col("score")).alias("score"))


@query
def degree_centrality(spark, sf_dir):
    return _scored(spark, sf_dir, "degree")


@query
def degree_with_self_loops(spark, sf_dir):
    return _scored(spark, sf_dir, "degree", self_loops=True)


@query
def closeness_centrality(spark, sf_dir):
    return _scored(spark, sf_dir, "closeness")


@query
def closeness_sketch(spark, sf_dir):
    """The taxa are few, and so small a set is counted by its sketch without an error."""
    return _scored(spark, sf_dir, "closeness_sketch")


@query
def betweenness_centrality(spark, sf_dir):
    return _scored(spark, sf_dir, "betweenness")


@query
def betweenness_draws(spark, sf_dir):
    """A bound of 0.01 takes every one of so few taxa as a start: the scores are exact."""
    return _scored(spark, sf_dir, "betweenness_draws", epsilon=0.01)


@query
def eigenvector_centrality(spark, sf_dir):
    return _scored(spark, sf_dir, "eigenvector", tol=1e-10)


@query
def top_taxa(spark, sf_dir):
    return graph.top_nodes(_scored(spark, sf_dir, "degree"), 5)


# --- divergence and winnowing ---------------------------------------------


@query
def kl_divergence(spark, sf_dir):
    profile = tables.smooth_profiles(tables.profiles(inputs.fine_counts(spark, sf_dir), "F", "O"))
    return divergence.kl_divergence(profile).select(rounded(F.col("kl"), 9).alias("kl"))


@query
def kl_divergence_raw(spark, sf_dir):
    """Unsmoothed: capped as soon as a taxon is missing on one side only."""
    out = divergence.kl_divergence(tables.profiles(inputs.fine_counts(spark, sf_dir), "F", "O"))
    return out.select(F.when(F.col("kl") > 1e49, F.lit(1e50)).otherwise(rounded(F.col("kl"), 9)).alias("kl"))


@query
def divergence_curve(spark, sf_dir):
    """Taxa dropped from the largest total down."""
    profile = cut(tables.smooth_profiles(tables.profiles(inputs.fine_counts(spark, sf_dir), "F", "O")))
    ranking = order.number_rows(profile, (), [(F.round(F.col("a") + F.col("b"), 12)).desc(), F.col("taxon").asc()], "rank")
    out = divergence.divergence_curve(profile, ranking)
    return out.withColumn("kl", rounded(F.col("kl"), 9))


@query
def winnow_loop(spark, sf_dir):
    """Pull the best-connected taxon, one a step, 50 in all."""
    params = WinnowParams(correlation="pearson", centrality="degree")
    pulled = winnow.run(inputs.linked_counts(spark, sf_dir), "F", "O", params)["pulled"]
    return pulled.select("step", "taxon", rounded(F.col("score")).alias("score"), rounded(F.col("kl"), 9).alias("kl"))


def _winnowed(spark: SparkSession, sf_dir: str, **limits) -> dict[str, DataFrame]:
    """The loop at its own defaults: Spearman, betweenness."""
    return winnow.run(inputs.linked_counts(spark, sf_dir), "F", "O", WinnowParams(**limits))


@query
def winnow_default(spark, sf_dir):
    """Pull the taxon that most shortest paths go through, one a step, 50 in all."""
    pulled = _winnowed(spark, sf_dir)["pulled"]
    return pulled.select("step", "taxon", rounded(F.col("score")).alias("score"), rounded(F.col("kl"), 9).alias("kl"))


@query
def winnow_kept(spark, sf_dir):
    """Smoothed profiles of the taxa that ten steps leave."""
    kept = _winnowed(spark, sf_dir, num_required=10)["kept"]
    return kept.select("taxon", rounded(F.col("a"), 9).alias("a"), rounded(F.col("b"), 9).alias("b"))


@query
def winnow_matrix(spark, sf_dir):
    """Smoothed counts of the taxa that ten steps leave."""
    matrix = _winnowed(spark, sf_dir, num_required=10)["matrix"]
    return matrix.select("condition", "sample_id", "taxon", rounded(F.col("smoothed"), 9).alias("smoothed"))


# --- sources and sinks ----------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for every call."""
    return f"{shared_dir(spark)}/furrow-{spark.conf.get('spark.app.id')}/files/{uuid4().hex}/{name}"


@query
def cached_histogram(spark, sf_dir):
    """Stored under its parameters, then read back."""
    path = _scratch(spark, "histograms")
    stamp = f"{sf_dir}|image_histogram"
    return cache.load_or_compute(spark, path, stamp, lambda: image_histogram(spark, sf_dir))


@query
def csv_profiles(spark, sf_dir):
    """Written as CSV and read back with inferred types."""
    path = _scratch(spark, "profiles.csv")
    files.write_csv(tables.profiles(inputs.fine_counts(spark, sf_dir), "F", "O"), path)
    return files.read_csv(spark, path)


@query
def group_files(spark, sf_dir):
    """One folder of names per group, read back."""
    path = _scratch(spark, "groups")
    label = series.nearest_label(F.col("metric"), LEVEL1)
    files.write_groups(inputs.frames(spark, sf_dir).withColumn("group", label), path)
    held = spark.read.schema("value string, `group` int").text(path)
    return held.select(F.col("value").alias("image_id"), "group")


@query
def frame_view(spark, sf_dir):
    """Frames registered as a view and summed by SQL."""
    files.register(inputs.frames(spark, sf_dir), "furrow_frames")
    return spark.sql(
        "SELECT batch, count(*) AS n_frames, count_if(counted) AS n_counted FROM furrow_frames GROUP BY batch"
    )

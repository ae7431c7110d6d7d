"""Summaries per period of the day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import local_clock, period_index, period_starts
from ..joins import attach, attach_measured, match


def in_periods(
    frames: DataFrame, by: Sequence[str], limits: Sequence[str], zone: str = "UTC", ts: str = "ts", key: str = "image_id"
) -> DataFrame:
    """Add each frame's 0-based ``period``.

    Periods lie on the local date of the group's first frame; frames of another
    date or without a time belong to none and are left out. The index is an
    expression of the local time, so no range join is needed.
    """
    clock = local_clock(F.col(ts), zone)
    # The first frame by key that has a time gives the date.
    dated = frames.filter(F.col(ts).isNotNull()).withColumn("_clock", clock)
    first = dated.groupBy(*by).agg(F.to_date(F.min_by("_clock", key)).alias("_day"))
    return (
        attach_measured(dated, first, by, [key])
        .filter(F.to_date("_clock") == F.col("_day"))
        .withColumn("period", period_index(F.col("_clock"), limits))
        .drop("_clock", "_day")
    )


def _every_period(frames: DataFrame, by: Sequence[str], limits: Sequence[str]) -> DataFrame:
    last = len(period_starts(limits)) - 1
    groups = frames.groupBy(*by).agg(F.lit(1).alias("_one")).drop("_one")
    return groups.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(last))))


def _whole_day(frames: DataFrame) -> DataFrame:
    return frames.withColumn("period", F.lit(0))


def mean_by_period(
    frames: DataFrame,
    by: Sequence[str],
    metric: str,
    limits: Sequence[str] | None = None,
    zone: str = "UTC",
    name: str = "mean_share",
    key: str = "image_id",
) -> DataFrame:
    """Mean metric per group and period, -1 where a period has no frame."""
    if limits is None:
        placed, every = _whole_day(frames), _whole_day(frames).groupBy(*by, "period").agg(F.lit(1).alias("_o")).drop("_o")
    else:
        placed, every = in_periods(frames, by, limits, zone, key=key), _every_period(frames, by, limits)
    means = placed.groupBy(*by, "period").agg(F.avg(metric).alias(name))
    return match(every, means, [*by, "period"], "left").withColumn(name, F.coalesce(name, F.lit(-1.0)))


def count_histogram(rows: DataFrame, by: Sequence[str], value: str, width: float) -> DataFrame:
    """Histogram of ``value`` per group: ``(by..., bin_left, n)`` with bins of ``width``.

    Bins start at multiples of the width; the last one also holds its right
    edge. Counting happens before the edges are known, so only one row per bin
    travels further.
    """
    if width <= 0:
        raise ValueError("bin width must be positive")
    index = F.floor(F.col(value) / F.lit(float(width))).cast("long")
    raw = (
        rows.filter(F.col(value).isNotNull())
        .withColumn("_bin", index)
        .withColumn("_edge", F.col(value) == F.col("_bin") * F.lit(float(width)))
        .groupBy(*by, "_bin", "_edge")
        .agg(F.count("*").alias("n"))
    )
    spans = raw.groupBy(*by).agg(
        F.min("_bin").alias("_lo"),
        F.max(F.when(F.col("_edge"), F.col("_bin")).otherwise(F.col("_bin") + 1)).alias("_hi"),
    )
    closed = attach(raw, spans, by, ["_bin"]).withColumn(
        "_bin", F.greatest(F.col("_lo"), F.least(F.col("_bin"), F.col("_hi") - 1))
    )
    return closed.groupBy(*by, (F.col("_bin") * F.lit(float(width))).alias("bin_left")).agg(F.sum("n").alias("n"))


def modal_value(rows: DataFrame, by: Sequence[str], value: str, tolerance: float, name: str = "typical") -> DataFrame:
    """Centre of the fullest bin per group; the lower bin on ties."""
    bins = count_histogram(rows, by, value, tolerance)
    fullest = F.max_by("bin_left", F.struct(F.col("n"), -F.col("bin_left")))
    return bins.groupBy(*by).agg((fullest + tolerance / 2.0).alias(name))


def modal_by_period(
    frames: DataFrame,
    by: Sequence[str],
    value: str,
    limits: Sequence[str] | None = None,
    zone: str = "UTC",
    tolerance: float = 5,
    name: str = "typical",
    counted: Column | None = None,
    key: str = "image_id",
) -> DataFrame:
    """Typical value per group and period, -1 where nothing was counted."""
    if limits is None:
        placed, every = _whole_day(frames), _whole_day(frames).groupBy(*by, "period").agg(F.lit(1).alias("_o")).drop("_o")
    else:
        placed, every = in_periods(frames, by, limits, zone, key=key), _every_period(frames, by, limits)
    if counted is not None:
        placed = placed.filter(counted)
    modes = modal_value(placed, [*by, "period"], value, tolerance, name)
    return match(every, modes, [*by, "period"], "left").withColumn(name, F.coalesce(name, F.lit(-1.0)))

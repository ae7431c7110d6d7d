"""Count tables in long form ``(condition, sample_id, taxon, n)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import attach, attach_measured


def stack(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both tables, columns matched by name; columns missing on one side become null."""
    return first.unionByName(second, allowMissingColumns=True)


def to_long(wide: DataFrame, label: str | None = None, name: str = "sample_id") -> DataFrame:
    """Wide matrix with a label column (the first one) to ``(sample, taxon, n)``; nulls become 0."""
    label = label or wide.columns[0]
    taxa = [c for c in wide.columns if c != label]
    doubles = wide.select(
        F.col(f"`{label}`").alias(name), *[F.coalesce(F.col(f"`{t}`").cast("double"), F.lit(0.0)).alias(t) for t in taxa]
    )
    return doubles.unpivot(name, [f"`{t}`" for t in taxa], "taxon", "n")


def prune_taxa(counts: DataFrame, min_count: float = 3) -> DataFrame:
    """Keep the taxa that exceed ``min_count`` in some sample."""
    kept = counts.groupBy("taxon").agg(F.max("n").alias("_most")).filter(F.col("_most") > min_count)
    return counts.join(kept.select("taxon"), "taxon", "left_semi")


def smooth_matrix(counts: DataFrame, sample: Sequence[str], kind: str = "b") -> DataFrame:
    """Add-one smoothing per taxon column, as ``smoothed``.

    ``a``: ``(n + 1) / column sum``; ``b``: ``(n + 1) / (column sum + samples)``,
    which sums to one.
    """
    totals = counts.groupBy("taxon").agg(F.sum("n").alias("_total"))
    rows = attach_measured(counts, totals, ["taxon"], sample)
    if kind == "b":
        rows = attach(rows, counts.select(*sample).distinct().agg(F.count("*").alias("_samples")), [], sample)
        bottom = F.col("_total") + F.col("_samples")
    elif kind == "a":
        bottom = F.col("_total")
    else:
        raise ValueError("smoothing kind is 'a' or 'b'")
    return rows.withColumn("smoothed", F.try_divide(F.col("n") + 1, bottom)).drop("_total", "_samples")


def profiles(counts: DataFrame, first, second) -> DataFrame:
    """Summed profile per taxon of two conditions: ``(taxon, a, b)``."""

    def side(value) -> Column:
        return F.coalesce(F.sum(F.when(F.col("condition") == value, F.col("n"))), F.lit(0.0))

    return counts.groupBy("taxon").agg(side(first).alias("a"), side(second).alias("b"))


def align(profile: DataFrame, kept: DataFrame) -> DataFrame:
    """Profile rows of the kept taxa only."""
    return profile.join(kept.select("taxon"), "taxon", "left_semi")


def smooth_profiles(profile: DataFrame, kind: str = "b") -> DataFrame:
    """Add-one smoothing of both profiles over their taxa."""
    if kind not in ("a", "b"):
        raise ValueError("smoothing kind is 'a' or 'b'")
    extra = F.count("*") if kind == "b" else F.lit(0)
    sums = profile.agg((F.sum("a") + extra).alias("_sa"), (F.sum("b") + extra).alias("_sb"))
    rows = attach(profile, sums, [], ["taxon"])
    return rows.select(
        "taxon",
        F.try_divide(F.col("a") + 1, F.col("_sa")).alias("a"),
        F.try_divide(F.col("b") + 1, F.col("_sb")).alias("b"),
    )

"""KL divergence of two profiles, whole and after dropping ranked taxa."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running_totals

CAP = 1e50


def _term() -> Column:
    """``a * log2(a / b)``: 0 where a is 0, infinite where only b is 0."""
    a, b = F.col("a"), F.col("b")
    return F.when(a == 0, 0.0).when(b == 0, F.lit(float("inf"))).otherwise(a * F.log2(a / F.nullif(b, F.lit(0.0))))


def _kl(terms: Column, sum_a: Column, sum_b: Column) -> Column:
    """Divergence of the profiles re-normalised to one, capped; null when nothing is left."""
    ratio = F.try_divide(sum_b, sum_a)
    value = F.try_divide(terms, sum_a) + F.log2(F.when(ratio > 0, ratio))
    return F.when(terms == float("inf"), F.lit(CAP)).when(value.isNotNull(), F.least(value, F.lit(CAP)))


def kl_divergence(profile: DataFrame) -> DataFrame:
    """One row ``kl`` for a profile table ``(taxon, a, b)``."""
    sums = profile.agg(F.sum(_term()).alias("t"), F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    return sums.select(_kl(F.col("t"), F.col("sa"), F.col("sb")).alias("kl"))


def divergence_curve(profile: DataFrame, ranking: DataFrame, rank: str = "rank") -> DataFrame:
    """``(k, kl)`` after dropping the k first-ranked taxa, for every k below the number of taxa.

    One pass: sums over the remaining taxa are running totals from the last
    rank to the first. Taxa without a rank are never dropped.
    """
    ranked = profile.join(ranking.select("taxon", F.col(rank).alias("_rank")), "taxon", "left")
    tails = running_totals(
        ranked,
        (),
        [F.col("_rank").desc_nulls_first(), F.col("taxon").desc()],
        {"_t": _term(), "_sa": F.col("a"), "_sb": F.col("b")},
    )
    kl = _kl(F.col("_t"), F.col("_sa"), F.col("_sb"))
    return tails.filter(F.col("_rank").isNotNull()).select((F.col("_rank") - 1).cast("long").alias("k"), kl.alias("kl"))

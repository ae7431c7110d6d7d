"""Feature selection: pull the most central taxa one step at a time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, scope
from ..operators import counts as tables
from ..operators.correlation import strong_pairs
from ..operators.divergence import divergence_curve, kl_divergence
from ..operators.graph import Standing, both_ways, centrality, top_nodes
from ..params import WinnowParams


def correlation_graph(counts: DataFrame, params: WinnowParams) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the thresholded correlation graph over all samples of a stored table."""
    cells = counts.withColumn("sample", F.concat_ws("|", "condition", F.col("sample_id").cast("string")))
    edges, taxa = strong_pairs(cells, params.correlation, params.keep_thresh, stored=True)
    return taxa.select(F.col("taxon").alias("id")), cut(edges)


def pulls(nodes: DataFrame, edges: DataFrame, params: WinnowParams, max_steps: int) -> list[tuple[int, str, float]]:
    """Taxa pulled per step as ``(step, taxon, score)``; at most ``num_required`` plus one step's worth.

    Correlations do not change when a taxon is dropped, so each step only
    removes nodes and ranks the rest. Betweenness and closeness are computed
    anew only where a drop can change them, the others from what is left.
    """
    steps = range(min(max_steps, math.ceil(params.num_required / params.num_to_pull)))
    pulled: list[tuple[int, str, float]] = []
    if params.centrality in ("betweenness", "closeness"):
        standing = Standing(nodes, edges, params.centrality)
        for step in steps:
            with scope(keep=(kept := [])):
                best = standing.pull(params.num_to_pull)
                kept.append(standing.held)
            if not best:
                break
            pulled += [(step, taxon, score) for taxon, score in best]
        standing.close()
        return pulled
    edges = cut(both_ways(edges))
    n_nodes = nodes.count()
    for step in steps:
        # One array literal keeps the generated code alike from step to step.
        gone = F.lit([taxon for _, taxon, _ in pulled]).cast("array<string>")

        def kept(name: str) -> Column:
            return ~F.array_contains(gone, F.col(name))

        left, links = nodes.filter(kept("id")), edges.filter(kept("src") & kept("dst"))
        with scope(keep=[]):
            scores = centrality(left, links, params.centrality, symmetric=True, n_nodes=n_nodes - len(pulled))
            best = top_nodes(scores, params.num_to_pull).collect()
        if not best:
            break
        pulled += [(step, row["node"], row["score"]) for row in best]
    return pulled


def run(counts: DataFrame, first, second, params: WinnowParams = WinnowParams()) -> dict[str, DataFrame]:
    """The whole loop on counts ``(condition, sample_id, taxon, n)``.

    Returns ``pulled`` ``(step, taxon, score, kl)``, the ``kept`` profiles
    (smoothed) and the ``matrix`` of the remaining taxa (smoothed).
    """
    kept: list[DataFrame] = []
    with scope(keep=kept):
        out = {name: cut(table) for name, table in _run(counts, first, second, params).items()}
        kept += out.values()
    return out


def _run(counts: DataFrame, first, second, params: WinnowParams) -> dict[str, DataFrame]:
    spark = counts.sparkSession
    # Stored before it is pruned, so that the counts are made once.
    counts = cut(tables.prune_taxa(cut(counts), params.min_count))
    nodes, edges = correlation_graph(counts, params)
    steps = pulls(nodes, edges, params, counts.select("taxon").distinct().count())
    taken = spark.createDataFrame(steps, "step int, taxon string, score double")
    profile = tables.smooth_profiles(tables.profiles(counts, first, second))
    order = spark.createDataFrame(
        [(taxon, i + 1) for i, (_, taxon, _) in enumerate(steps)], "taxon string, rank bigint"
    )
    # The divergence after a step is the one with all taxa pulled so far dropped.
    after = spark.createDataFrame(
        [(step, sum(s <= step for s, _, _ in steps)) for step in sorted({s for s, _, _ in steps})],
        "step int, k bigint",
    )
    curve = _after_last(profile, order, divergence_curve(profile, order))
    kl = after.join(curve, "k", "left").select("step", "kl")
    return {
        "pulled": taken.join(kl, "step", "left"),
        "kept": profile.join(taken, "taxon", "left_anti"),
        "matrix": tables.smooth_matrix(counts, ["condition", "sample_id"]).join(taken, "taxon", "left_anti"),
    }


def _after_last(profile: DataFrame, order: DataFrame, curve: DataFrame) -> DataFrame:
    """Add the value after the last ranked taxon is dropped as well."""
    rest = kl_divergence(profile.join(order, "taxon", "left_anti"))
    n = order.agg(F.count("*").alias("k"))
    return curve.unionByName(rest.select(n.select("k").scalar().alias("k"), "kl"))
